"""Registered queries on the reference's operators, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import chem
from dossier.operators import records, rules, scoring, text

from .fixtures import fixture, with_fixtures

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
N_BOOT = 10_000
QUERY_VECTOR = [((7 * i) % 11 - 5) / 5 for i in range(64)]

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return register


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


CAS_SETS = """g AS (SELECT DISTINCT doc_id, cas FROM fx_gold_ing WHERE cas IS NOT NULL),
p AS (SELECT DISTINCT doc_id, cas FROM fx_pred_ing WHERE cas IS NOT NULL),
j AS (SELECT COALESCE(g.doc_id, p.doc_id) AS doc_id, g.cas AS a, p.cas AS b FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.cas = p.cas),
c AS (SELECT doc_id, SUM(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS fn FROM j GROUP BY doc_id)"""
MICRO = """SELECT subset, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn,
 CASE WHEN SUM(tp + fp + fn) > 0 THEN ROUND(COALESCE(SUM(tp) / CAST(NULLIF(SUM(tp + fp), 0) AS DOUBLE), 0), 6) END AS p,
 CASE WHEN SUM(tp + fp + fn) > 0 THEN ROUND(COALESCE(SUM(tp) / CAST(NULLIF(SUM(tp + fn), 0) AS DOUBLE), 0), 6) END AS r,
 ROUND(CAST(2 * SUM(tp) AS DOUBLE) / NULLIF(SUM(2 * tp + fp + fn), 0), 6) AS f1
 FROM c JOIN fx_doc d ON c.doc_id = d.doc_id GROUP BY subset"""


def cas_counts(s, d):
    return scoring.set_counts(fixture(s, d, "fx_gold_ing"), fixture(s, d, "fx_pred_ing"), "doc_id", "cas")


@query("WITH " + CAS_SETS + MICRO)
def cas_micro_f1_by_subset(s, d):
    return scoring.micro(cas_counts(s, d).join(fixture(s, d, "fx_doc"), "doc_id"), "subset")


@query("WITH " + CAS_SETS + ", m AS (" + MICRO + """) SELECT subset, metric, value FROM (SELECT subset, 'tp' AS metric, CAST(tp AS DOUBLE) AS value FROM m
UNION ALL SELECT subset, 'fp', fp FROM m UNION ALL SELECT subset, 'fn', fn FROM m UNION ALL SELECT subset, 'p', p FROM m UNION ALL SELECT subset, 'r', r FROM m UNION ALL SELECT subset, 'f1', f1 FROM m)""")  # fmt: skip
def metrics_long_unpivot(s, d):
    return scoring.long_metrics(cas_micro_f1_by_subset(s, d), "subset")


@query("WITH " + CAS_SETS + ", m AS (" + MICRO + """), l AS (SELECT subset, 'tp' AS metric, CAST(tp AS DOUBLE) AS value FROM m UNION ALL SELECT subset, 'f1', f1 FROM m)
SELECT metric, """ + ", ".join(f"""MAX(CASE WHEN subset = '{r}' THEN value END) AS "{r}" """ for r in REGIONS) + " FROM l GROUP BY metric")  # fmt: skip
def compare_pivot(s, d):
    regions = [r[0] for r in table(s, d, "region").select("r_name").orderBy("r_name").collect()]  # a dimension of few rows
    return scoring.wide_metrics(metrics_long_unpivot(s, d).where("metric in ('tp', 'f1')"), "subset", regions)


KEY = r"""CASE WHEN content IS NULL THEN 'null' WHEN LEN(n) = 2 THEN 'P:' || least(n[1], n[2]) || ':' || greatest(n[1], n[2])
 WHEN LEN(n) = 1 AND regexp_matches(content, '<|≤|미만|이하') THEN 'P:0.0:' || n[1] WHEN LEN(n) = 1 AND regexp_matches(content, '>|≥|이상|초과') THEN 'P:' || n[1] || ':100.0'
 WHEN LEN(n) = 1 THEN 'P:' || n[1] || ':' || n[1] ELSE 'S:' || regexp_replace(content, '\s+', '', 'g') END"""
NUMBERS = r"CAST(regexp_extract_all(content, '([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE[])"


def _bag(gold_where: str, key: str) -> str:
    return f"""WITH gk AS (SELECT doc_id, {key} AS k, content, {NUMBERS} AS n FROM fx_gold_ing WHERE {gold_where}),
pk AS (SELECT doc_id, {key} AS k, content, {NUMBERS} AS n FROM fx_pred_ing WHERE {gold_where}),
g AS (SELECT doc_id, k, {KEY} AS v, COUNT(*) AS n FROM gk GROUP BY ALL), p AS (SELECT doc_id, k, {KEY} AS v, COUNT(*) AS n FROM pk GROUP BY ALL),
j AS (SELECT COALESCE(g.doc_id, p.doc_id) AS doc_id, COALESCE(g.n, 0) AS a, COALESCE(p.n, 0) AS b FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.k = p.k AND g.v = p.v),
c AS (SELECT doc_id, SUM(LEAST(a, b)) AS tp, SUM(b - LEAST(a, b)) AS fp, SUM(a - LEAST(a, b)) AS fn FROM j GROUP BY doc_id) """ + MICRO


@query(_bag("cas IS NOT NULL", "cas"))
def pair_bag_match(s, d):
    own = lambda t: fixture(s, d, t).where("cas is not null")
    counts = scoring.bag_counts(own("fx_gold_ing"), own("fx_pred_ing"), "doc_id", F.col("cas"), chem.content_key(F.col("content")))
    return scoring.micro(counts.join(fixture(s, d, "fx_doc"), "doc_id"), "subset")


@query(_bag("cas IS NULL", "is_sub"))
def nocas_bag_match(s, d):
    own = lambda t: fixture(s, d, t).where("cas is null")
    counts = scoring.bag_counts(own("fx_gold_ing"), own("fx_pred_ing"), "doc_id", F.col("is_sub"), chem.content_key(F.col("content")))
    return scoring.micro(counts.join(fixture(s, d, "fx_doc"), "doc_id"), "subset")


@query(f"""WITH c AS (SELECT DISTINCT content, {NUMBERS} AS n FROM fx_gold_ing)
SELECT content, CASE WHEN LEN(n) = 2 THEN least(n[1], n[2]) WHEN LEN(n) = 1 AND regexp_matches(content, '<|≤|미만|이하') THEN 0 WHEN LEN(n) = 1 THEN n[1] END AS lo,
 CASE WHEN LEN(n) = 2 THEN greatest(n[1], n[2]) WHEN LEN(n) = 1 AND regexp_matches(content, '>|≥|이상|초과') THEN 100 WHEN LEN(n) = 1 THEN n[1] END AS hi,
 CASE WHEN LEN(n) = 1 AND regexp_matches(content, '미만|이하|<') THEN 0 ELSE list_min(n) END AS lower_bound FROM c""")  # fmt: skip
def content_parse_minmax(s, d):
    c = fixture(s, d, "fx_gold_ing").select("content").distinct()
    b = chem.content_bounds(F.col("content"))
    return c.select("content", b["lo"].alias("lo"), b["hi"].alias("hi"), chem.content_lower(F.col("content")).alias("lower_bound"))


CAS_SQL = """SELECT doc_id, seq, 'cas' AS check_name, 'error' AS severity, CASE WHEN NOT regexp_full_match(cas, '[0-9]{2,7}-[0-9]{2}-[0-9]') THEN 'CAS_FORMAT_INVALID' ELSE 'CAS_CHECKSUM_INVALID' END AS code
 FROM (SELECT *, reverse(replace(cas, '-', '')) AS r FROM {t} WHERE cas IS NOT NULL) WHERE NOT regexp_full_match(cas, '[0-9]{2,7}-[0-9]{2}-[0-9]')
 OR list_sum(list_transform(range(2, length(r) + 1), lambda k: (k - 1) * CAST(r[k] AS BIGINT))) % 10 <> CAST(r[1] AS BIGINT)"""


@query("WITH b AS (" + CAS_SQL.replace("{t}", "fx_typo_cas") + """) SELECT COALESCE(b.code, 'ok') AS code, COUNT(*) AS n FROM fx_typo_cas c LEFT JOIN b ON c.doc_id = b.doc_id AND c.seq = b.seq WHERE c.cas IS NOT NULL GROUP BY 1""")
def cas_checksum_audit(s, d):
    own = fixture(s, d, "fx_typo_cas").where("cas is not null")
    return own.groupBy(F.coalesce(rules.bad_cas(F.col("cas")), F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT doc_id, list_sort(list(DISTINCT cas) FILTER (cas IS NOT NULL)) AS v FROM fx_gold_ing GROUP BY doc_id),
p AS (SELECT doc_id, list_sort(list(DISTINCT cas) FILTER (cas IS NOT NULL)) AS v FROM fx_pred_ing GROUP BY doc_id)
SELECT subset, COUNT(*) AS n_docs, ROUND(AVG(CASE WHEN p.doc_id IS NOT NULL AND COALESCE(array_to_string(g.v, ','), '') = COALESCE(array_to_string(p.v, ','), '') THEN 1.0 ELSE 0.0 END), 6) AS exact_rate
FROM g LEFT JOIN p ON g.doc_id = p.doc_id JOIN fx_doc d ON g.doc_id = d.doc_id GROUP BY subset""")
def doc_exact_rates(s, d):
    own = lambda t: fixture(s, d, t).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("cas")), ",").alias(t))
    both = own("fx_gold_ing").join(own("fx_pred_ing"), "doc_id", "left").join(fixture(s, d, "fx_doc"), "doc_id")
    exact = F.coalesce(F.col("fx_gold_ing") == F.col("fx_pred_ing"), F.lit(False)).cast("double")
    return both.groupBy("subset").agg(F.count("*").alias("n_docs"), F.round(F.avg(exact), 6).alias("exact_rate"))


@query("""WITH m AS (SELECT doc_id, max(pos) AS pos FROM fx_log GROUP BY doc_id)
SELECT l.doc_id, l.pos, l.skipped, l.gen_time, l.input_tokens FROM fx_log l JOIN m ON l.doc_id = m.doc_id AND l.pos = m.pos""")
def latest_log_per_doc(s, d):
    return records.last_by(fixture(s, d, "fx_log"), "doc_id", "pos")


@query("""WITH m AS (SELECT doc_id, max(pos) AS pos FROM fx_log GROUP BY doc_id), l AS (SELECT l.* FROM fx_log l JOIN m ON l.doc_id = m.doc_id AND l.pos = m.pos)
SELECT COUNT(*) AS n, SUM(CASE WHEN skipped THEN 1 ELSE 0 END)::BIGINT AS n_skipped, ROUND(AVG(gen_time) FILTER (NOT skipped), 4) AS mean_time, ROUND(AVG(input_tokens) FILTER (NOT skipped), 4) AS mean_tokens FROM l""")
def log_token_means(s, d):
    done = ~F.col("skipped")
    mean = lambda c: F.round(F.avg(F.when(done, F.col(c))), 4)
    return latest_log_per_doc(s, d).agg(F.count("*").alias("n"), F.count_if("skipped").alias("n_skipped"), mean("gen_time").alias("mean_time"), mean("input_tokens").alias("mean_tokens"))


OUTCOMES = """x AS (SELECT doc_id, COUNT(*) AS x FROM fx_gold_ing WHERE cas IS NOT NULL GROUP BY doc_id), y AS (SELECT doc_id, COUNT(*) AS y FROM fx_pred_ing WHERE cas IS NOT NULL GROUP BY doc_id)"""


@query("WITH " + OUTCOMES + """ SELECT subset, COUNT(*) FILTER (y > x) AS win, COUNT(*) FILTER (y < x) AS loss, COUNT(*) FILTER (y = x) AS tie, ROUND(AVG(y - x), 6) AS mean_diff, COUNT(*) AS n_docs, COUNT(DISTINCT grp) AS n_groups
FROM x JOIN y ON x.doc_id = y.doc_id JOIN fx_doc d ON x.doc_id = d.doc_id GROUP BY subset""")  # fmt: skip
def paired_win_loss_tie(s, d):
    n = lambda t: fixture(s, d, t).where("cas is not null").groupBy("doc_id").agg(F.count("*").alias("v"))
    return scoring.win_loss_tie(n("fx_gold_ing").join(fixture(s, d, "fx_doc"), "doc_id"), n("fx_pred_ing"), "doc_id", ["subset", "grp"], "v")


@query()
def group_bootstrap_ci(s, d):
    n = lambda t, v: fixture(s, d, t).where("cas is not null").groupBy("doc_id").agg(F.count("*").alias(v))
    both = n("fx_gold_ing", "x").join(n("fx_pred_ing", "y"), "doc_id").join(fixture(s, d, "fx_doc"), "doc_id")
    groups = both.groupBy("subset", "grp").agg(F.sum(F.col("y") - F.col("x")).alias("t"), F.count("*").alias("n"))
    ci = scoring.bootstrap_interval(groups, "subset", "grp", "t", "n", N_BOOT)
    return ci.withColumn("conclusion", scoring.conclusion(F.col("ci_low"), F.col("ci_high")))


COUNTS = " SELECT check_name, severity, code, COUNT(*) AS n FROM f GROUP BY ALL"


def by_code(findings):
    return findings.groupBy("check_name", "severity", "code").agg(F.count("*").alias("n"))


HCODE_SQL = """SELECT h.doc_id, h.seq, 'hcode' AS check_name, CASE WHEN NOT regexp_full_match(h.code, 'H[0-9]{3}[A-Za-z]{0,2}(\\+H[0-9]{3}[A-Za-z]{0,2})*') THEN 'error' ELSE 'warning' END AS severity,
 CASE WHEN NOT regexp_full_match(h.code, 'H[0-9]{3}[A-Za-z]{0,2}(\\+H[0-9]{3}[A-Za-z]{0,2})*') THEN 'HCODE_FORMAT_INVALID' ELSE 'HCODE_UNKNOWN_CODE' END AS code
 FROM fx_haz h LEFT JOIN fx_phrase p ON h.code = p.code WHERE p.code IS NULL AND h.code IS NOT NULL"""
PHRASE_SQL = """SELECT doc_id, seq, 'phrase_to_hcode' AS check_name, 'error' AS severity, 'HCODE_PHRASE_MISMATCH' AS code FROM (SELECT h.doc_id, h.seq,
 bool_or(regexp_replace(replace(h.text, ' ', ''), '[.。]+$', '') = regexp_replace(replace(p.phrase, ' ', ''), '[.。]+$', '')) AS ok FROM fx_haz h JOIN fx_phrase p ON h.code = p.code GROUP BY h.doc_id, h.seq) WHERE NOT ok"""
SUM_SQL = f"""SELECT doc_id, CAST(NULL AS BIGINT) AS seq, 'content_sum' AS check_name, 'error' AS severity, 'CONTENT_SUM_EXCEEDS_100' AS code FROM (SELECT doc_id, CASE WHEN LEN(n) = 1 AND regexp_matches(content, '미만|이하|<') THEN 0 ELSE list_min(n) END AS lo
 FROM (SELECT doc_id, content, {NUMBERS} AS n FROM fx_gold_ing)) GROUP BY doc_id HAVING SUM(lo) > 100.5"""


@query(f"WITH f AS ({HCODE_SQL}){COUNTS}")
def hcode_lookup_findings(s, d):
    return by_code(rules.check_hcode(fixture(s, d, "fx_haz"), fixture(s, d, "fx_phrase")))


@query(f"WITH f AS ({PHRASE_SQL}){COUNTS}")
def phrase_mismatch_findings(s, d):
    return by_code(rules.check_phrase(fixture(s, d, "fx_haz"), fixture(s, d, "fx_phrase")))


#: The rule's own steps: reverse look-up of phrases, stated and expected codes, the strongest expected word.
SIGNAL_STEPS = """r AS (SELECT trim(phrase) AS phrase, arg_min(code, row_no) AS code FROM fx_phrase GROUP BY 1),
c AS (SELECT DISTINCT doc_id, code FROM (SELECT doc_id, unnest(string_split(code, '+')) AS code FROM fx_haz WHERE code <> ''
 UNION ALL SELECT h.doc_id, r.code FROM fx_haz h JOIN r ON trim(h.text) = r.phrase WHERE COALESCE(h.code, '') = '')),
l AS (SELECT g.doc_id, g.seq, d.codes, CASE d.signal_word WHEN '위험' THEN 2 WHEN '경고' THEN 1 ELSE 0 END AS w FROM fx_ghs g LEFT JOIN fx_dim d ON g.hazard_class = d.hazard_class AND g.category = d.category),
e AS (SELECT doc_id, seq, unnest(string_split(codes, '|')) AS code FROM l WHERE codes IS NOT NULL),
m AS (SELECT e.doc_id, e.seq FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.code = c.code GROUP BY e.doc_id, e.seq HAVING COUNT(c.code) = 0),
w AS (SELECT doc_id, MAX(w) AS want FROM l WHERE codes IS NOT NULL GROUP BY doc_id),
u AS (SELECT DISTINCT c.doc_id FROM c JOIN w ON c.doc_id = w.doc_id LEFT JOIN (SELECT DISTINCT doc_id, code FROM e) x ON c.doc_id = x.doc_id AND c.code = x.code WHERE x.code IS NULL)"""
SIGNAL_FOUND = """SELECT doc_id, seq, 'ghs_signal_hcode_consistency' AS check_name, 'info' AS severity, 'CLASSIFICATION_NOT_IN_TABLE' AS code FROM l WHERE codes IS NULL
 UNION ALL SELECT doc_id, seq, 'ghs_signal_hcode_consistency', 'error', 'HCODE_MISSING_FOR_CLASSIFICATION' FROM m
 UNION ALL SELECT doc_id, NULL, 'ghs_signal_hcode_consistency', 'error', 'HCODE_MISSING_FOR_CLASSIFICATION' FROM u
 UNION ALL SELECT w.doc_id, NULL, 'ghs_signal_hcode_consistency', 'error', 'SIGNAL_WORD_MISMATCH' FROM w LEFT JOIN fx_signal s ON w.doc_id = s.doc_id
 WHERE CASE want WHEN 2 THEN '위험' WHEN 1 THEN '경고' END IS DISTINCT FROM s.signal_word"""


@query(f"WITH {SIGNAL_STEPS}, f AS ({SIGNAL_FOUND}){COUNTS}")
def ghs_signal_consistency(s, d):
    return by_code(rules.check_signal(*(fixture(s, d, t) for t in ("fx_ghs", "fx_haz", "fx_signal", "fx_dim", "fx_phrase"))))


@query(f"WITH f AS ({SUM_SQL}){COUNTS}")
def content_sum_over_100(s, d):
    return by_code(rules.check_content_sum(fixture(s, d, "fx_gold_ing")))


@query("SELECT doc_id, seq AS position, name, cas, content, is_sub FROM fx_gold_ing")
def regroup_round_trip(s, d):
    return records.unnest(records.nest(fixture(s, d, "fx_gold_ing"), "doc_id", "seq"), "doc_id").drop("seq")


@query("""WITH m AS (SELECT document_id, MAX(batch) AS batch FROM fx_review GROUP BY document_id)
SELECT r.document_id, r.field_path, r.batch, arg_max(r.confirmed_value, r.id) AS confirmed_value FROM fx_review r JOIN m ON r.document_id = m.document_id AND r.batch = m.batch GROUP BY r.document_id, r.field_path, r.batch""")
def latest_review_batch(s, d):
    return records.latest_batch(fixture(s, d, "fx_review"))


@query("SELECT id, document_id, field_path, ROW_NUMBER() OVER (PARTITION BY document_id, field_path ORDER BY id) AS revision FROM fx_review")
def revision_sequence(s, d):
    return records.revisions(fixture(s, d, "fx_review").select("id", "document_id", "field_path"), ["document_id", "field_path"], "id")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 10 <> 0 ORDER BY o_orderkey DESC LIMIT 25 OFFSET 50")
def table_page_desc_offset(s, d):
    sealed = table(s, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return records.page(records.sealed_out(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), sealed, "o_custkey"), "o_orderkey", 50, 25)


@query("""SELECT grp, string_agg(split, ',' ORDER BY split) AS splits, CAST(SUM(n) AS BIGINT) AS n_docs FROM (SELECT grp, split, COUNT(*) AS n FROM fx_split GROUP BY grp, split) GROUP BY grp HAVING COUNT(*) > 1""")
def group_leakage(s, d):
    return records.leaking_groups(fixture(s, d, "fx_split"), "grp")


@query("""SELECT DISTINCT a.text AS text_key FROM (SELECT sha256(text) AS text FROM fx_split WHERE split = 'train') a JOIN (SELECT sha256(text) AS text FROM fx_split WHERE split = 'val') b ON a.text = b.text""")
def overlap_ids(s, d):
    own = fixture(s, d, "fx_split").select("split", F.sha2("text", 256).alias("text_key"))
    return own.where("split = 'train'").select("text_key").intersect(own.where("split = 'val'").select("text_key"))


@query("""WITH p AS (SELECT source, substring(sha256(text), 1, 3) AS prefix, COUNT(*) AS n, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS part FROM documents GROUP BY 1, 2)
SELECT source, CAST(SUM(n) AS BIGINT) AS n, sha256(string_agg(prefix || ':' || part, chr(10) ORDER BY prefix)) AS set_sha256 FROM p GROUP BY source""")
def set_hash(s, d):
    return records.manifest(table(s, d, "documents"), "source", "text")


@query("""SELECT h, COUNT(*) AS n FROM (SELECT sha256(text) AS h FROM documents) GROUP BY h HAVING COUNT(*) > 1""")
def manifest_bag_diff(s, d):
    h = table(s, d, "documents").select(F.sha2("text", 256).alias("h"))
    extra = h.exceptAll(h.distinct())  # copies beyond the first
    return extra.groupBy("h").agg((F.count("*") + 1).alias("n"))


@query("""SELECT code, COUNT(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '(^|[^A-Za-z])H ([0-9]{3})', '\\1H\\2', 'g'), '(?:^|[^A-Za-z])(H[0-9]{3})', 1))) AS code FROM fx_text) GROUP BY code""")
def hcode_extract(s, d):
    own = fixture(s, d, "fx_text").select("doc_id", F.explode(chem.hcodes_of(text.join_codes(F.col("text")))).alias("code"))
    return own.groupBy("code").agg(F.countDistinct("doc_id").alias("n"))


@query("""WITH c AS (SELECT doc_id, unnest(list_transform(range(1, length(text) + 1), lambda i: text[i])) AS ch, unnest(range(1, length(text) + 1)) AS i FROM fx_split),
r AS (SELECT doc_id, ch, i - ROW_NUMBER() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM c WHERE NOT regexp_matches(ch, '\\s')), k AS (SELECT doc_id, 4 * COUNT(*) AS k FROM r GROUP BY doc_id, ch, g),
n AS (SELECT doc_id, k, COUNT(*) AS n FROM k GROUP BY doc_id, k), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS rank FROM n) SELECT doc_id, CAST(k AS INTEGER) AS k, n FROM b WHERE rank = 1 AND n >= 20""")
def bold_repeat_factor(s, d):
    own = fixture(s, d, "fx_split").select("doc_id", F.regexp_replace("text", r"(\S)", "$1$1$1$1").alias("text"))
    return text.repeat_factor(own)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM fx_text),
h AS (SELECT *, TRY_CAST(regexp_extract(line, '^\\s*(1[0-6]|[1-9])\\s*[.)]', 1) AS INTEGER) AS num FROM l), s AS (SELECT doc_id, n, line, COALESCE(last_value(num IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 0) AS section FROM h)
SELECT doc_id, section, string_agg(line, chr(10) ORDER BY n) AS body FROM s GROUP BY doc_id, section""")
def heading_sections(s, d):
    return text.sections(fixture(s, d, "fx_text"))


@query("""WITH n AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 150) / 1050.0) AS BIGINT)) AS n FROM documents),
c AS (SELECT doc_id, text, unnest(range(0, n)) AS chunk FROM n) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, substring(text, chunk * 1050 + 1, 1200) AS text FROM c""")
def chunk_overlap(s, d):
    return text.chunks(table(s, d, "documents").select("doc_id", "text"))


@query(f"""WITH s AS (SELECT product AS label, vec_id, ROUND(list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)), 6) AS score FROM (SELECT product, vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST({QUERY_VECTOR} AS DOUBLE[]) AS q FROM fx_chunk WHERE section IN (2, 3, 4))),
r AS (SELECT label, vec_id, score, ROW_NUMBER() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 4""")
def topk_cosine_filtered(s, d):
    return text.top_k(fixture(s, d, "fx_chunk").where("section in (2, 3, 4)").withColumnRenamed("product", "label"), QUERY_VECTOR, 4)


@query("""WITH r AS (SELECT role, length(text) AS n, ROW_NUMBER() OVER (PARTITION BY role ORDER BY length(text)) - 1 AS k, COUNT(*) OVER (PARTITION BY role) AS c FROM conversations),
h AS (SELECT *, round_even(0.5 * (c - 1), 0) AS p50, round_even(0.9 * (c - 1), 0) AS p90, round_even(0.95 * (c - 1), 0) AS p95 FROM r)
SELECT role, MAX(n) FILTER (k = p50)::INTEGER AS p50, MAX(n) FILTER (k = p90)::INTEGER AS p90, MAX(n) FILTER (k = p95)::INTEGER AS p95, ROUND(AVG(n), 6) AS mean, MAX(n)::INTEGER AS max FROM h GROUP BY role""")
def length_percentiles(s, d):
    own = table(s, d, "conversations").select("role", F.length("text").alias("n"))
    return records.percentiles(own, "role", "n", [50, 90, 95])


@query("""SELECT p_type, p_brand, CAST(COUNT(*) AS BIGINT) AS n FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '1') GROUP BY ALL""")
def document_facet_filter(s, d):
    own = table(s, d, "part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("1"))
    return own.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, COUNT(*) AS n_turns, CAST(SUM(length(text)) AS BIGINT) AS n_chars, SUM(length(text)) > 2000 AS too_long FROM conversations GROUP BY conv_id""")
def overlength_quarantine(s, d):
    own = table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    return own.withColumn("too_long", F.col("n_chars") > 2000)


from . import catalog_documents, catalog_engines, catalog_functions, catalog_rules, catalog_scores  # noqa: E402, F401  (they register their queries here)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
