"""Safety-document shaped inputs derived from the given tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: Tables that are dealt by order: rows of a partition at most, about, and the key. Both give the same number of partitions.
DEALT = {"lineitem": (200_000, "l_orderkey"), "orders": (50_000, "o_orderkey")}

#: A table where a statement reads it.
NAMED = re.compile(r"\b(?:FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")

FIXTURES = {
    # One row per ingredient of a document: a CAS number with a right check digit, a content in one of six forms.
    "fx_line": """SELECT l_orderkey AS doc_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
 l_suppkey, l_extendedprice) AS seq, l_partkey AS pk, l_partkey % 9000 + 1000 AS a, l_suppkey % 90 + 10 AS b FROM lineitem""",
    "fx_gold_ing": """SELECT doc_id, seq, CONCAT('part ', CAST(pk AS STRING)) AS name,
 CASE WHEN (pk + seq) % 11 = 0 THEN NULL ELSE CONCAT(CAST(a AS STRING), '-', CAST(b AS STRING), '-',
 CAST((b % 10 + 2 * CAST(FLOOR(b / 10) AS BIGINT) + 3 * (a % 10) + 4 * (CAST(FLOOR(a / 10) AS BIGINT) % 10)
 + 5 * (CAST(FLOOR(a / 100) AS BIGINT) % 10) + 6 * CAST(FLOOR(a / 1000) AS BIGINT)) % 10 AS STRING)) END AS cas,
 CASE (doc_id + seq) % 6 WHEN 0 THEN '10~20' WHEN 1 THEN '10 이상 ~ 20 미만' WHEN 2 THEN '<1' WHEN 3 THEN '≥90' WHEN 4 THEN '15 %' END AS content,
 (pk + seq) % 11 = 0 AS is_sub FROM fx_line""",
    "fx_pred_ing": """SELECT doc_id, seq, name,
 CASE WHEN (doc_id * 7 + seq) % 10 = 2 AND cas IS NOT NULL THEN CONCAT(SUBSTRING(cas, 1, LENGTH(cas) - 1), 'x') ELSE cas END AS cas,
 CASE WHEN (doc_id * 7 + seq) % 10 = 1 THEN '33' WHEN (doc_id * 7 + seq) % 10 = 4 THEN REPLACE(content, ' ', '') ELSE content END AS content,
 is_sub FROM fx_gold_ing WHERE (doc_id * 7 + seq) % 10 <> 0""",
    # Identifiers with a wrong last digit, and some that are none.
    "fx_typo_cas": """SELECT doc_id, seq, CASE WHEN cas IS NULL THEN NULL WHEN (doc_id + seq) % 7 = 0 THEN CONCAT(SUBSTRING(cas, 1, LENGTH(cas) - 1), CAST((doc_id + seq) % 10 AS STRING))
 WHEN (doc_id + seq) % 7 = 1 THEN CONCAT(cas, '0') ELSE cas END AS cas FROM fx_gold_ing""",
    "fx_doc": """SELECT o_orderkey AS doc_id, r_name AS subset, n_name AS grp, o_orderpriority AS form FROM orders
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_dim": """SELECT * FROM (VALUES ('flammable', '1', '위험', 'H224'), ('flammable', '2', '위험', 'H225'),
 ('flammable', '3', '경고', 'H226'), ('corrosive', '1', '위험', 'H314'), ('irritant', '2', '경고', 'H315'),
 ('toxic', '3', '위험', 'H301|H311'), ('toxic', '4', '경고', 'H302')) t(hazard_class, category, signal_word, codes)""",
    "fx_phrase": """SELECT * FROM (VALUES (1, 'H224', 'extremely flammable'), (2, 'H225', 'highly flammable'), (3, 'H225', 'flammable'), (4, 'H226', 'flammable'),
 (5, 'H314', 'causes burns'), (6, 'H315', 'irritates skin'), (7, 'H301', 'toxic'), (8, 'H302', 'harmful')) t(row_no, code, phrase)""",
    # Classes and statements of documents, some of them wrong.
    "fx_ghs": """SELECT doc_id, seq, CASE pk % 5 WHEN 0 THEN 'flammable' WHEN 1 THEN 'corrosive' WHEN 2 THEN 'irritant'
 WHEN 3 THEN 'toxic' ELSE 'explosive' END AS hazard_class, CAST(a % 4 + 1 AS STRING) AS category FROM fx_line""",
    "fx_haz": """SELECT doc_id, seq, CASE b % 9 WHEN 0 THEN 'H224' WHEN 1 THEN 'H225' WHEN 2 THEN 'H226' WHEN 3 THEN 'H314'
 WHEN 4 THEN 'H315' WHEN 5 THEN 'H301+H311' WHEN 6 THEN NULL WHEN 7 THEN 'H999' ELSE 'X12' END AS code,
 CASE a % 7 WHEN 0 THEN 'Extremely flammable.' WHEN 1 THEN 'highly flammable' WHEN 2 THEN 'flammable' WHEN 3 THEN 'causes burns'
 WHEN 4 THEN 'irritates skin' WHEN 5 THEN 'toxic' ELSE 'harmful.' END AS text FROM fx_line""",
    # Four values of each document, some of which stand for none.
    "fx_value": """SELECT o_orderkey AS doc_id, name, CASE (o_orderkey + k) % 9 WHEN 0 THEN '자료없음' WHEN 1 THEN ' - ' WHEN 2 THEN 'N/A' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'p' END AS value,
 CASE WHEN (o_custkey + k) % 4 = 0 THEN '자료없음' ELSE '기재' END AS source_status FROM orders
 CROSS JOIN (SELECT * FROM (VALUES (0, 'product_name'), (1, 'recommended_use'), (2, 'use_restrictions'), (3, 'signal_word')) t(k, name)) f""",
    # Predicted classes and statements: some rows are left out, some are changed.
    "fx_pred_ghs": """SELECT doc_id, seq, CASE WHEN (doc_id * 5 + seq) % 9 = 2 THEN 'unheard' ELSE hazard_class END AS hazard_class,
 CASE WHEN (doc_id * 5 + seq) % 9 = 1 THEN '4' ELSE category END AS category FROM fx_ghs WHERE (doc_id * 5 + seq) % 9 <> 0""",
    "fx_pred_haz": """SELECT doc_id, seq, CASE WHEN (doc_id * 3 + seq) % 8 = 1 THEN 'H335' ELSE code END AS code,
 CASE WHEN (doc_id * 3 + seq) % 8 = 2 THEN 'toxic' ELSE text END AS text FROM fx_haz WHERE (doc_id * 3 + seq) % 8 <> 0""",
    # What the run of a model says of each document, and single values of both sides.
    "fx_run": """SELECT o_orderkey AS doc_id, o_orderkey % 17 <> 0 AS has_output, o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AS parsed,
 o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AND o_custkey % 7 <> 0 AS schema_ok, o_orderkey % 19 = 0 AS hit_max, CAST(o_custkey % 50 AS DOUBLE) AS gen_time,
 o_custkey % 900 AS input_tokens, o_custkey % 700 AS output_tokens, o_orderkey % 5 <> 0 AS product_name, o_custkey % 6 <> 0 AS signal_word,
 o_orderkey % 8 <> 0 AS ghs_status, o_custkey % 9 <> 0 AS hazard_status FROM orders""",
    "fx_signal": "SELECT o_orderkey AS doc_id, CASE o_custkey % 3 WHEN 0 THEN '위험' WHEN 1 THEN '경고' END AS signal_word FROM orders",
    "fx_log": """SELECT event_id AS pos, user_id AS doc_id, event_type = 'error' AS skipped, value AS gen_time,
 CAST(FLOOR(value * 10) AS BIGINT) AS input_tokens FROM events""",
    "fx_review": """SELECT event_id AS id, user_id AS document_id, event_type AS field_path, CAST(FLOOR(event_id / 97) AS BIGINT) AS batch,
 CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) AS confirmed_value FROM events""",
    "fx_split": """SELECT doc_id, lang, source AS grp, CASE WHEN doc_id % 7 = 0 THEN 'val' WHEN doc_id % 11 = 0 THEN 'test'
 ELSE 'train' END AS split, text FROM documents""",
    # A whole document under numbered headings, with a precaution block and codes; some lack a heading, have a table of contents
    # first, or hide a code in the block.
    "fx_text": """SELECT doc_id, CONCAT(CASE WHEN doc_id % 6 = 0 THEN CONCAT('4. First aid measures', chr(10)) ELSE '' END, '1. Product', chr(10), 'name ', CAST(doc_id AS STRING), chr(10),
 CASE WHEN doc_id % 13 = 5 THEN '' ELSE CONCAT(CASE WHEN doc_id % 4 = 1 THEN 'SECTION 2' ELSE '2. Hazards' END, chr(10)) END, 'H 225 highly flammable', chr(10),
 CASE WHEN doc_id % 5 = 1 THEN '' ELSE CONCAT('Precautionary statements', chr(10)) END, CASE WHEN doc_id % 5 = 0 THEN 'H314 hidden' ELSE 'P210 keep away' END, chr(10),
 CASE WHEN doc_id % 3 = 0 THEN CONCAT('Other hazards: H412', chr(10)) ELSE '' END, CASE WHEN doc_id % 17 = 3 THEN '' ELSE CONCAT('3. Composition', chr(10)) END,
 COALESCE(text, ''), chr(10), CASE WHEN doc_id % 11 = 2 THEN '' ELSE CONCAT(CASE WHEN doc_id % 2 = 0 THEN '4. First-aid measures' ELSE '제 4 항' END, chr(10)) END, 'rinse H301') AS text FROM documents""",
    # Predicted values in wrong columns, by place.
    "fx_misplaced": """SELECT doc_id, seq, CASE (doc_id + seq) % 9 WHEN 0 THEN 'KE-12345' WHEN 1 THEN '200-578-6' WHEN 2 THEN ' ke-123 ' END AS ke,
 CASE WHEN (doc_id + seq) % 13 = 0 THEN cas ELSE content END AS content FROM fx_pred_ing""",
    # One source line for each ingredient; some identifiers are broken by a space, some are left out.
    "fx_line_text": """SELECT doc_id, seq, cas, CONCAT('row: ', CASE (doc_id + seq) % 5 WHEN 0 THEN REPLACE(cas, '-', '- ') WHEN 1 THEN 'none' ELSE cas END) AS line
 FROM fx_gold_ing WHERE cas IS NOT NULL""",
    # Stored records as JSON, with errors of several kinds.
    "fx_json": """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'not json' ELSE CONCAT('{"product_name":{"value":',
 CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE '"p"' END, ',"source_status":"기재"},"recommended_use":{"value":null,"source_status":"',
 CASE WHEN o_custkey % 7 = 0 THEN 'maybe' ELSE '자료없음' END, '"},"use_restrictions":{"value":null,"source_status":"해당없음"},"signal_word":{"value":"',
 CASE WHEN o_custkey % 3 = 0 THEN 'DANGER' ELSE '위험' END, '","source_status":"기재"},"supplier":{"company_name":"c","address":null',
 CASE WHEN o_custkey % 4 = 0 THEN '' ELSE ',"emergency_phone":null' END, '},"ingredients":[],"ghs_classification":[{"hazard_class":"x","category":"',
 CASE WHEN o_custkey % 6 = 0 THEN '2' ELSE '구분 2' END, '"}],"hazard_statements":[],"list_status":{"ingredients":"',
 CASE WHEN o_custkey % 13 = 0 THEN '기재' ELSE '자료없음' END, '","ghs_classification":"기재","hazard_statements":"자료없음"}}') END AS json FROM orders""",
    "fx_chunk": "SELECT vec_id, label AS product, CAST(vec_id % 16 + 1 AS INT) AS section, embedding FROM embeddings",
    # Model answers: bare JSON, fenced, within a sentence, broken.
    "fx_answer": """SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN CONCAT('<think>no</think>', '```json', chr(10), props, chr(10), '```')
 WHEN 2 THEN CONCAT('Here: ', props, ' done') ELSE 'sorry' END AS answer FROM events""",
    "fx_korean": """SELECT doc_id, CONCAT('1. 화학제품과 회사', chr(10), '가. 제품명 : ', source, chr(10), '- 위험', chr(10), '2. 유해성', chr(10),
 'CAS 번호 64-17-5 80 이상', chr(10), '3. 구성성분', chr(10), text) AS text FROM documents""",
    "fx_category": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN CONCAT('Category ', CAST(p_size % 4 + 1 AS STRING)) WHEN 1 THEN CONCAT('구분', CAST(p_size % 4 + 1 AS STRING), '(1A/1B)')
 WHEN 2 THEN CASE p_size % 4 WHEN 0 THEN 'Refrigerated liquefied gas' WHEN 1 THEN '폭발물 1.1 류' WHEN 2 THEN 'Type x' ELSE 'Liquefied gas' END WHEN 3 THEN ' - ' ELSE CONCAT('Cat. ', CAST(p_size % 4 + 1 AS STRING), 'b') END AS category FROM part""",
}


def selected(name: str) -> tuple[str, str]:
    """The columns of a fixture without its keys (doc_id, seq), as its SELECT has them, and what it is FROM."""
    columns, source = re.fullmatch(r"(?s)SELECT (.*) FROM (\w+)(?: WHERE .*)?", FIXTURES[name]).groups()
    return re.sub(r"^(doc_id, seq|o_orderkey AS doc_id), ", "", columns), source


def beside(rows: DataFrame, name: str, prefix: str, given: str = "") -> DataFrame:
    """The rows with a fixture's columns, made of theirs (of those with the prefix `given`), under a prefix; `there` is whether the
    fixture has the row, and the others are null where it hasn't."""
    columns, where = re.fullmatch(r"(?s)SELECT doc_id, seq, (.*) FROM \w+(?: WHERE (.*))?", FIXTURES[name]).groups()
    there = f"({where})" if where else f"{given}there"
    own = [re.fullmatch(r"(?s)(?:(.*) AS )?(\w+)", c).groups() for c in split_columns(columns)]
    read = lambda e: re.sub(r"(?<!')\b(cas|content)\b(?!')", given + r"\1", e) if given else e
    return rows.selectExpr("*", f"{there} AS {prefix}there", *(f"CASE WHEN {there} THEN {read(e or c)} END AS {prefix}{c}" for e, c in own))


def column_of(name: str, column: str) -> str:
    """The expression of a fixture's last column."""
    return re.search(rf"(?s)(?:^|, )((?:CASE|CONCAT)\b.*) AS {column}$", selected(name)[0]).group(1)


def wide(spark: SparkSession, sf_dir: str, table: str, names: list[str], view: str | None = None) -> DataFrame:
    """The columns of several fixtures over one table, or over one fixture of it, in one scan; expressions may name columns of
    the fixtures before them."""
    if view:
        rows = fixture(spark, sf_dir, view)
    else:
        rows = dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"), table).withColumn("doc_id", F.col("o_orderkey"))
    for name in names:
        rows = rows.selectExpr("*", *split_columns(selected(name)[0]))
    return rows


def split_columns(columns: str) -> list[str]:
    """A SELECT list's columns: cut at commas outside brackets and quotes."""
    out, depth, quoted, begin = [], 0, False, 0
    for k, c in enumerate(columns):
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            out.append(columns[begin:k].strip())
            begin = k + 1
    return [*out, columns[begin:].strip()]


def values_of_record() -> str:
    """fx_value's rows of a document as one array of structs (name, value, source_status)."""
    columns = re.match(r"(?s)SELECT o_orderkey AS doc_id, name, (.*?) FROM orders\s", FIXTURES["fx_value"]).group(1)
    names = re.findall(r"\((\d), '(\w+)'\)", FIXTURES["fx_value"])
    rows = []
    for k, name in names:
        value, state = (re.sub(r"\bk\b", k, c).rsplit(" AS ", 1)[0] for c in split_columns(columns))
        rows.append(f"named_struct('name', '{name}', 'value', {value}, 'source_status', {state})")
    return f"array({', '.join(rows)})"


def needed(body: str) -> list[str]:
    """The fixtures that a statement names, those they need first."""
    out: list[str] = []

    def add(text: str):
        for name, sql in FIXTURES.items():
            if name in text and name not in out and sql != text:
                add(sql)
                if name not in out:
                    out.append(name)

    add(body)
    return out


def with_fixtures(body: str) -> str:
    parts = [f"{name} AS ({FIXTURES[name]})" for name in needed(body)]
    if not parts:
        return body
    stripped = body.strip()
    recursive = stripped.upper().startswith("WITH")
    return "WITH " + ",\n".join(parts) + (",\n" + stripped[4:] if recursive else "\n" + stripped)


def fixture(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The fixture's rows; tables are read into views with a prefix of their own, so that a session's views stay. `given`: rows
    that stand for fixtures which this one is made of."""
    sql = with_fixtures(f"SELECT * FROM {name}")
    for base, rows in (given or {}).items():
        view = f"dossier_{base}_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        sql = sql.replace(f"{base} AS ({FIXTURES[base]})", f"{base} AS (SELECT * FROM {view})")
    joined = name == "fx_doc"  # on other keys
    for table in set(NAMED.findall(sql)):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (rows if joined else dealt(rows, table)).createOrReplaceTempView(f"dossier_{table}")
    return spark.sql(NAMED.sub(lambda m: m[0].replace(m[1], f"dossier_{m[1]}"), sql))


def dealt(rows: DataFrame, table: str) -> DataFrame:
    """The rows of a table of DEALT, hashed by order into partitions whose number grows with the table, so that a task holds as
    much of a large table as of a small one, and what is gathered or joined by document later needs no other shuffle."""
    if table not in DEALT:
        return rows
    most, key = DEALT[table]
    return rows.repartition(partitions(rows, most), key)


def partitions(rows: DataFrame, most: int) -> int:
    """A power of two: partitions of `most` rows, but one a core, unless these had few rows."""
    n, power = rows.count(), lambda x: 1 << max(0, math.ceil(x) - 1).bit_length()  # noqa: E731  (Parquet counts from its footers)
    return min(max(power(n / most), power(rows.sparkSession.sparkContext.defaultParallelism)), power(n * 100 / most))
