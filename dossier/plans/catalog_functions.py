"""Registered queries on scalar functions, records, gates and the review screen, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import chem, textnorm
from dossier.operators import governance, records, retrieval, review, text

from .catalog import query, table
from .fixtures import fixture


@query("""WITH n AS (SELECT p_partkey, p_name || ', ' || repeat('(', p_size % 12) || 'x [1]' || repeat(')', p_size % 12) || ' · Co' AS name FROM part)
SELECT p_partkey, lower(replace(regexp_replace(CASE WHEN p_partkey % 1 = 0 THEN list_reduce(list_prepend(name, list_transform(range(14), lambda i: '')), lambda a, b: regexp_replace(a, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g')) END, '[,·]', '', 'g'), ' ', '')) AS name_key,
 lower(replace(p_name, ' ', '')) AS plain_key FROM n JOIN part USING (p_partkey)""")
def product_name_keys(s, d):
    """Names with notes in up to eleven brackets."""
    k = (F.col("p_size") % 12).cast("int")
    name = F.concat(F.col("p_name"), F.lit(", "), F.repeat(F.lit("("), k), F.lit("x [1]"), F.repeat(F.lit(")"), k), F.lit(" · Co"))
    return table(s, d, "part").select("p_partkey", textnorm.product_name_key(name).alias("name_key"), textnorm.key(F.col("p_name")).alias("plain_key"))


@query("""WITH c AS (SELECT doc_id, seq, CASE seq % 3 WHEN 0 THEN replace(cas, '-', '‐') WHEN 1 THEN replace(cas, '-', ' – ') ELSE ' ' || cas END AS raw, cas FROM fx_gold_ing)
SELECT doc_id, seq, cas AS cas_key FROM c""")
def cas_keys(s, d):
    """Dashes of other kinds and white space don't matter."""
    own = fixture(s, d, "fx_gold_ing")
    raw = F.when(F.col("seq") % 3 == 0, F.replace("cas", F.lit("-"), F.lit("‐"))).when(F.col("seq") % 3 == 1, F.replace("cas", F.lit("-"), F.lit(" – "))).otherwise(F.concat(F.lit(" "), "cas"))
    return own.select("doc_id", "seq", textnorm.cas_key(raw).alias("cas_key"))


@query("""SELECT doc_id, name, value, CASE WHEN value IS NULL THEN FALSE ELSE trim(value) = '' OR lower(trim(value)) IN ('자료없음', '-', 'n/a') END AS is_sentinel FROM fx_value""")
def sentinel_values(s, d):
    return fixture(s, d, "fx_value").select("doc_id", "name", "value", textnorm.is_sentinel(F.col("value")).alias("is_sentinel"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '위험' WHEN 1 THEN '경고' WHEN 2 THEN '위험' WHEN 3 THEN '경고' ELSE '없음이다' END AS signal FROM orders""")
def signal_words(s, d):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, " Danger ").when(k == 1, "WARNING").when(k == 2, "위 험").when(k == 3, "경고").otherwise("없음 이다")
    return table(s, d, "orders").select("o_orderkey", chem.norm_signal_word(raw).alias("signal"))


@query("""WITH k AS (SELECT doc_id, seq, content, lead(content) OVER (PARTITION BY doc_id ORDER BY seq) AS other FROM fx_gold_ing),
n AS (SELECT *, CASE content WHEN '10~20' THEN 1 WHEN '10 이상 ~ 20 미만' THEN 1 WHEN '<1' THEN 2 WHEN '≥90' THEN 3 WHEN '15 %' THEN 4 END AS a,
 CASE other WHEN '10~20' THEN 1 WHEN '10 이상 ~ 20 미만' THEN 1 WHEN '<1' THEN 2 WHEN '≥90' THEN 3 WHEN '15 %' THEN 4 END AS b FROM k)
SELECT doc_id, seq, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE a = b END AS same FROM n""")
def contents_equal(s, d):
    from pyspark.sql import Window

    other = F.lead("content").over(Window.partitionBy("doc_id").orderBy("seq"))
    own = fixture(s, d, "fx_gold_ing").withColumn("other", other)
    return own.select("doc_id", "seq", textnorm.content_equal(F.col("content"), F.col("other")).alias("same"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, CAST(200000 + l_partkey * 37 % 800000 AS VARCHAR) AS digits FROM lineitem),
t AS (SELECT *, list_sum(list_transform(range(1, 7), lambda k: k * CAST(digits[k] AS BIGINT))) % 11 AS c FROM n) SELECT l_orderkey, l_linenumber, digits, CASE WHEN c <> 10 THEN CAST(c AS INTEGER) END AS check_digit FROM t""")
def ec_check_digits(s, d):
    digits = (F.lit(200000) + F.col("l_partkey") * 37 % 800000).cast("string")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", digits.alias("digits"), textnorm.ec_check_digit(digits).cast("int").alias("check_digit"))


@query("SELECT event_id, strftime(ts, '%Y.%m.%d %H:%M') AS shown FROM events")
def screen_times(s, d):
    return table(s, d, "events").select("event_id", textnorm.screen_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("shown"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN '' WHEN page_id % 4 = 2 THEN 'HTTPS://x/' || page_id ELSE url END AS safe FROM (SELECT page_id, CASE WHEN regexp_matches(lower(url), '^(https?|blob):') THEN url ELSE '' END AS url FROM pages)""")
def safe_urls(s, d):
    raw = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("javascript:"), "url")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("HTTPS://x/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(s, d, "pages").select("page_id", textnorm.safe_url(raw).alias("safe"))


@query("""SELECT event_id, ROUND(CASE WHEN event_id % 1000 < 100 THEN 0.001 * (event_id % 1000) / 100.0 ELSE 0.0005 * (1 + cos(pi() * ((event_id % 1000) - 100) / 900.0)) END, 9) AS lr FROM events""")
def learning_rates(s, d):
    step = F.col("event_id") % 1000
    return table(s, d, "events").select("event_id", F.round(textnorm.learning_rate(step, 1000, 100, 0.001), 9).alias("lr"))


@query("""SELECT doc_id, seq, regexp_extract(CASE WHEN seq % 3 = 0 THEN name ELSE '$.' || 'ingredients[' || seq || '].name' END, '^\\$\\.([a-z_]+)', 1) AS f FROM fx_gold_ing""".replace("SELECT doc_id, seq, regexp_extract", "SELECT doc_id, seq, NULLIF(regexp_extract").replace(", 1) AS f", ", 1), '') AS f"))
def top_fields(s, d):
    path = F.when(F.col("seq") % 3 == 0, F.col("name")).otherwise(F.concat(F.lit("$.ingredients["), F.col("seq").cast("string"), F.lit("].name")))
    return fixture(s, d, "fx_gold_ing").select("doc_id", "seq", textnorm.top_field(path).alias("f"))


@query("""WITH l AS (SELECT doc_id, seq, line, cas FROM fx_line_text) SELECT doc_id, seq, regexp_replace(list_last(regexp_split_to_array(trim(line || CASE WHEN seq % 2 = 0 THEN ').' ELSE '' END), '[:\\s]+')), '[.)]+$', '') AS token,
 replace(replace(line, '–', '~'), ' ', '') AS flat FROM l""")
def evidence_tokens(s, d):
    from dossier.operators import evidence

    line = F.concat("line", F.when(F.col("seq") % 2 == 0, ").").otherwise(""))
    return fixture(s, d, "fx_line_text").select("doc_id", "seq", evidence.last_token(line).alias("token"), evidence.flat(F.col("line")).alias("flat"))


@query("""SELECT doc_id, seq, category AS canonical, category IS NOT NULL AS known FROM (SELECT doc_id, seq, CASE hazard_class WHEN 'flammable' THEN 'Flammable liquids' WHEN 'corrosive' THEN 'Skin corrosion' ELSE hazard_class END AS category, hazard_class FROM fx_ghs) WHERE hazard_class IN ('flammable', 'corrosive')
UNION ALL SELECT doc_id, seq, hazard_class, FALSE FROM fx_ghs WHERE hazard_class NOT IN ('flammable', 'corrosive')""")
def canonical_classes(s, d):
    aliases = s.createDataFrame([("Flammable", "Flammable liquids"), ("CORROSIVE ", "Skin corrosion")], "raw string, canonical string")
    return textnorm.canonical_class(fixture(s, d, "fx_ghs"), aliases, "hazard_class").select("doc_id", "seq", "canonical", "known")


@query("""WITH u AS (SELECT page_id, octet_length(encode(html)) AS size, page_id % 3 AS k FROM pages) SELECT 'p' || page_id AS path, CASE WHEN k = 0 THEN 'not_pdf' WHEN k = 1 AND size > 3000 THEN 'too_large' WHEN k = 1 AND page_id % 5 = 0 THEN 'sealed' WHEN k = 2 AND size > 3000 THEN 'too_large' WHEN k = 2 AND page_id % 5 = 0 THEN 'sealed' END AS reason FROM u WHERE NOT (k = 0 AND size + 0 > 3000)
UNION ALL SELECT 'p' || page_id, 'too_large' FROM u WHERE k = 0 AND size > 3000""")
def upload_reasons(s, d):
    body = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.concat(F.lit("%PDF-"), F.substring("html", 6, 1 << 30)))
    files = table(s, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), body.cast("binary").alias("content"), "page_id")
    sealed = files.where("page_id % 5 = 0 and page_id % 3 <> 0").select(F.sha2("content", 256).alias("sha256"))
    return review.upload_gate(files.drop("page_id"), sealed, 3000).select("path", "reason")


@query("""SELECT conv_id, turn, trim(text) <> '' AND length(text) <= 300 AS ok FROM conversations""")
def question_gates(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", review.question_gate(F.col("text"), 300).alias("ok"))


BADGES = """e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'REVIEW_REQUIRED' WHEN 2 THEN 'SOURCE_CHECK_REQUIRED' END AS st, value > 50 AS ev, user_id % 7 = 0 AS rv, user_id % 5 = 0 AS wn FROM events)"""


@query(f"""WITH {BADGES} SELECT event_id, CASE WHEN rv THEN 'confirmed' WHEN wn THEN 'check_source' WHEN st <> 'OK' THEN 'review' WHEN st IS NULL THEN 'not_compared' WHEN ev THEN 'matches' ELSE 'no_evidence' END AS badge,
 COALESCE(st = 'OK' AND ev AND NOT wn AND NOT rv, FALSE) AS can_confirm FROM e""")
def badges(s, d):
    k = F.col("event_id") % 4
    st = F.when(k == 0, "OK").when(k == 1, "REVIEW_REQUIRED").when(k == 2, "SOURCE_CHECK_REQUIRED")
    ev, rv, wn = F.col("value") > 50, F.col("user_id") % 7 == 0, F.col("user_id") % 5 == 0
    return table(s, d, "events").select("event_id", review.badge(st, ev, rv, wn).alias("badge"), review.can_confirm(st, ev, F.lit(False), wn, rv).alias("can_confirm"))


@query("""SELECT l.doc_id, l.seq, CASE WHEN l.seq % 2 = 0 THEN FALSE ELSE NOT contains(line, cas) END AS unverified FROM fx_line_text l""")
def unverified_hazards(s, d):
    status = F.when(F.col("seq") % 2 == 0, "OK").otherwise("SOURCE_CHECK_REQUIRED")
    own = fixture(s, d, "fx_line_text")
    return own.select("doc_id", "seq", review.unverified_hazard(status, F.col("line"), F.col("cas"), F.lit(""), F.lit(False)).alias("unverified"))


@query("""SELECT c_custkey AS document_id, field_path, confirmed_value, 1 AS batch FROM (SELECT c_custkey, unnest(['product_name', 'list_status.ingredients']) AS field_path, unnest([c_name, c_mktsegment]) AS confirmed_value FROM customer)""")
def saved_review_events(s, d):
    saves = table(s, d, "customer").select(
        F.col("c_custkey").alias("document_id"), F.lit(1).alias("batch"), F.create_map(F.lit("product_name"), "c_name").alias("fields"),
        F.create_map(F.lit("ingredients"), "c_mktsegment").alias("states"),
    )
    return review.save_events(saves)


@query("""SELECT doc_id, 'missing: ' || concat_ws(',', CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN nullif(source, 'src7') IS NULL THEN 'source' END) AS reason FROM documents WHERE lang IS NULL OR nullif(source, 'src7') IS NULL""")
def unshowable_documents(s, d):
    own = table(s, d, "documents").withColumn("source", F.nullif("source", F.lit("src7")))
    return review.showable(own, ["lang", "source"])[1].select("doc_id", "reason")


@query("""SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'F' AND x.o_custkey = orders.o_custkey AND x.o_orderpriority = orders.o_orderpriority)""")
def rows_not_loaded(s, d):
    orders = table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return review.not_loaded(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"]).drop("o_orderstatus")


@query("""SELECT d.doc_id, d.source AS old, d.source || '2' AS new FROM documents d WHERE d.doc_id % 3 = 0""")
def rename_links(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("source_file"))
    new = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("source_file", F.lit("2"))).otherwise(F.col("source_file")).alias("source_file"))
    return governance.rename_plan(docs, new)[0]


@query("""WITH a AS (SELECT source AS kind, 'f' || doc_id AS name, sha256(text) AS h FROM documents), b AS (SELECT kind, CASE WHEN kind = 'src7' THEN name || 'x' ELSE name END AS name, h FROM a WHERE NOT (kind = 'src1' AND name LIKE '%3')),
x AS (SELECT kind, h, SUM(s) AS s FROM (SELECT kind, h, 1 AS s FROM a UNION ALL SELECT kind, h, -1 FROM b) GROUP BY kind, h), n AS (SELECT kind, SUM(greatest(s, 0)) AS n_missing, SUM(greatest(-s, 0)) AS n_extra FROM x GROUP BY kind)
SELECT kind, CAST(n_missing AS BIGINT) AS n_missing, CAST(n_extra AS BIGINT) AS n_extra, n_missing = 0 AND n_extra = 0 AND kind = 'src7' AS renamed FROM n""")
def manifest_verify(s, d):
    a = table(s, d, "documents").select(F.col("source").alias("kind"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    b = a.where(~((F.col("kind") == "src1") & F.col("name").endswith("3"))).withColumn("name", F.when(F.col("kind") == "src7", F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return governance.verify(a, b)


@query("""WITH l AS (SELECT doc_id, 'labels' AS s FROM labels UNION ALL SELECT doc_id, 'texts' FROM documents UNION ALL SELECT doc_id, 'train' FROM fx_split WHERE split = 'train')
SELECT doc_id, concat_ws(',', CASE WHEN NOT bool_or(s = 'labels') THEN 'labels' END, CASE WHEN NOT bool_or(s = 'texts') THEN 'texts' END, CASE WHEN NOT bool_or(s = 'train') THEN 'train' END) AS missing_in FROM l GROUP BY doc_id
HAVING COUNT(DISTINCT s) < 3""")
def pre_seal_ids(s, d):
    return records.id_disagreement({"labels": table(s, d, "labels"), "texts": table(s, d, "documents"), "train": fixture(s, d, "fx_split").where("split = 'train'")}, "doc_id")


@query("""WITH r AS (SELECT source, COALESCE(CAST(doc_id AS VARCHAR), '') || chr(0) || COALESCE(lang, '') AS row FROM documents), h AS (SELECT source, sha256(row) AS h FROM r),
p AS (SELECT source, substring(h, 1, 3) AS prefix, COUNT(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS part FROM h GROUP BY 1, 2)
SELECT source, CAST(SUM(n) AS BIGINT) AS n, sha256(string_agg(prefix || ':' || part, chr(10) ORDER BY prefix)) AS set_sha256 FROM p GROUP BY source""")
def inputs_digests(s, d):
    return records.inputs_digest(table(s, d, "documents"), "source", "doc_id", "lang")


@query("""SELECT doc_id AS name, sha256(text) AS sha256, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE sha256(text || '!') END AS now FROM documents WHERE doc_id % 9 = 0 OR doc_id % 4 = 0""")
def precheck_hashes(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"), F.sha2(F.concat("text", F.lit("!")), 256).alias("other"))
    now = docs.where("name % 9 <> 0").select("name", F.when(F.col("name") % 4 == 0, F.col("other")).otherwise(F.col("sha256")).alias("sha256"))
    return governance.changed_hashes(docs, now)


@query("""WITH s AS (SELECT DISTINCT user_id AS run, event_type AS name, 'v' || (user_id % 3) AS value FROM events), g AS (SELECT * FROM (VALUES ('click', 'v0'), ('purchase', 'v1'), ('frozen', 'yes')) t(name, wanted))
SELECT r.run, g.name, s.value, g.wanted FROM (SELECT DISTINCT run FROM s) r CROSS JOIN g LEFT JOIN s ON r.run = s.run AND g.name = s.name WHERE s.value IS DISTINCT FROM g.wanted""")
def freeze_gates(s, d):
    own = table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("name"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("value")).distinct()
    gates = s.createDataFrame([("click", "v0"), ("purchase", "v1"), ("frozen", "yes")], "name string, wanted string")
    return governance.gate_violations(own, gates)


@query("""SELECT event_id, user_id, event_type, CAST(100 * (user_id % 2) + ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS BIGINT) AS revision FROM events""")
def stored_revisions(s, d):
    events = table(s, d, "events").select("event_id", "user_id", "event_type")
    stored = events.where("user_id % 2 = 1").select("user_id", "event_type").distinct().withColumn("revision", F.lit(100))
    return records.next_revisions(events, stored, ["user_id", "event_type"], "event_id")


@query("SELECT doc_id, source, CAST(ROW_NUMBER() OVER (ORDER BY source, doc_id) AS BIGINT) AS number FROM documents WHERE source IS NOT NULL")
def document_numbers(s, d):
    return records.numbered(table(s, d, "documents").where("source is not null").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", F.col("number").cast("long").alias("number"))


@query("""SELECT conv_id, string_agg(role, chr(10) ORDER BY turn) AS values FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 5 GROUP BY conv_id""")
def first_messages(s, d):
    return records.heads(table(s, d, "conversations"), "conv_id", "turn", "role", 5)


@query()
def calibration_sample(s, d):
    return records.calibration(table(s, d, "documents").select("doc_id", F.length("text").alias("tokens")), "doc_id", "tokens", 200, 32, 42)


@query("""SELECT conv_id, CAST(SUM(length(text)) AS BIGINT) AS tokens, SUM(length(text)) = MAX(SUM(length(text))) OVER () AS longest FROM conversations GROUP BY conv_id HAVING SUM(length(text)) > 500""")
def overlength_list(s, d):
    n = table(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("tokens"))
    most = n.agg(F.max("tokens").alias("most"))
    return n.where("tokens > 500").join(most).select("conv_id", "tokens", (F.col("tokens") == F.col("most")).alias("longest")).orderBy(F.desc("tokens"), "conv_id")


@query("""SELECT doc_id, string_agg(COALESCE(cas, 'None'), ',' ORDER BY COALESCE(cas, 'None')) AS cas_set FROM (SELECT DISTINCT doc_id, cas FROM fx_gold_ing) GROUP BY doc_id""")
def null_safe_sets(s, d):
    named = F.coalesce("cas", F.lit("None"))
    return fixture(s, d, "fx_gold_ing").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(named)), ",").alias("cas_set"))


@query("""SELECT user_id, ROUND(AVG(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS ok_rate FROM events GROUP BY user_id""")
def field_ok_rates(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "click").cast("double")), 6).alias("ok_rate"))


@query("""SELECT doc_id, source FROM documents WHERE source IN ('src7', 'src2')""")
def owner_rows(s, d):
    owners = ["src7", "src2"]
    return table(s, d, "documents").where(F.col("source").isin(owners)).select("doc_id", "source")


@query("""SELECT p.page_id, d.source FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS stem FROM pages) p JOIN documents d ON d.doc_id = p.page_id WHERE regexp_full_match(stem, '[A-Za-z0-9_-]+')""")
def allowed_files(s, d):
    named = table(s, d, "pages").where(F.col("page_id").cast("string").rlike(governance.ID))
    return named.join(table(s, d, "documents"), F.col("page_id") == F.col("doc_id")).select("page_id", "source")


@query("""SELECT doc_id, lag(line) OVER (PARTITION BY doc_id ORDER BY seq) AS above, seq FROM fx_line_text""")
def line_above(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.when(F.trim("line") != "", F.col("line"))
    return fixture(s, d, "fx_line_text").select("doc_id", F.last(shown, ignorenulls=True).over(w).alias("above"), "seq")


#: A line as `page_of` compares it: no white space, and of characters that repeat only the first.
COLLAPSED = """array_to_string(list_transform(list_filter(range(1, length(x) + 1), lambda i: i = 1 OR x[i] <> x[i - 1]), lambda i: x[i]), '')"""


@query(f"""WITH n AS (SELECT doc_id, seq, regexp_replace(line, '[\\s\\x0B]+', '', 'g') AS x FROM fx_line_text), m AS (SELECT doc_id, seq, {COLLAPSED} AS line FROM n),
l AS (SELECT doc_id, seq, {COLLAPSED} AS line FROM (SELECT doc_id, seq, regexp_replace(string_split(line, chr(10))[1], '[\\s\\x0B]+', '', 'g') AS x FROM fx_line_text WHERE seq = 2))
SELECT l.doc_id, MIN(m.seq) FILTER (l.line <> '' AND contains(m.line, l.line)) AS page FROM l JOIN m ON l.doc_id = m.doc_id GROUP BY l.doc_id, l.seq""")
def evidence_page(s, d):
    from dossier.operators import evidence

    own = fixture(s, d, "fx_line_text")
    pages = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("p"))
    asked = own.where("seq = 2").select("doc_id", F.col("line").alias("snippet")).join(pages, "doc_id")
    at = evidence.page_of(F.transform("p", lambda x: x["line"]), F.col("snippet"))
    return asked.select("doc_id", F.get("p", (at - 1).cast("int"))["seq"].alias("page"))


@query("""SELECT k, CASE WHEN k > 1 THEN 2 WHEN k = 1 THEN 4 ELSE 8 END AS wanted FROM (SELECT DISTINCT CAST(p_size % 4 AS INTEGER) AS k FROM part)""")
def chunks_wanted(s, d):
    own = table(s, d, "part").select((F.col("p_size") % 4).cast("int").alias("k")).distinct()
    return own.select("k", retrieval.chunks_wanted(F.col("k"), F.col("k") == 1).cast("int").alias("wanted"))


@query("""SELECT vec_id, product, section FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product, section ORDER BY vec_id) AS k FROM fx_chunk) WHERE FALSE
UNION ALL SELECT MIN(vec_id), product, section FROM fx_chunk GROUP BY product, section""")
def distinct_evidence(s, d):
    own = fixture(s, d, "fx_chunk").groupBy("product", "section").agg(F.min("vec_id").alias("vec_id"))
    twice = own.union(own).select("vec_id", "product", "section", F.lit(1).alias("doc_id"), F.lit(0).alias("chunk"), F.lit("[x]\ny").alias("text"))
    return retrieval.distinct_evidence(twice).select("vec_id", "product", "section")


@query()
def recursive_chunks(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("product"), F.lit(1).alias("section"), F.lit("text").alias("title"), F.col("text").alias("body"))
    return text.recursive_chunks(docs)


@query("""WITH s AS (SELECT p_partkey AS doc_id, CASE p_partkey % 7 WHEN 0 THEN '/abs/x' WHEN 1 THEN 'a/../b' WHEN 2 THEN '' ELSE 'dir/' || p_name END AS source_file, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_brand END AS lang FROM part)
SELECT 'blank_source_file' AS rule, CAST(doc_id AS VARCHAR) AS key FROM s WHERE source_file = '' UNION ALL SELECT 'blank_lang', CAST(doc_id AS VARCHAR) FROM s WHERE trim(lang) = '' UNION ALL SELECT 'outside_root', CAST(doc_id AS VARCHAR) FROM s WHERE doc_id % 7 IN (0, 1)""")
def source_list_violations(s, d):
    k = F.col("p_partkey") % 7
    file = F.when(k == 0, "/abs/x").when(k == 1, "a/../b").when(k == 2, "").otherwise(F.concat(F.lit("dir/"), "p_name"))
    own = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), file.alias("source_file"), F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_brand")).alias("lang"))
    return governance.source_violations(own, ["doc_id", "source_file", "lang"])


@query("""SELECT p_partkey, p_brand FROM part WHERE contains(lower(p_name || ' ' || p_type), 'e') AND contains(lower(p_name || ' ' || p_type), 'a') AND p_size = 7""")
def document_search(s, d):
    own = table(s, d, "part").withColumn("searched", F.concat_ws(" ", "p_name", "p_type"))
    return records.matching(own, "searched", ["E", "a"], {"p_size": 7}).select("p_partkey", "p_brand")


@query("""WITH m AS (SELECT user_id, max(event_id) AS id FROM events GROUP BY user_id), l AS (SELECT e.* FROM events e JOIN m ON e.user_id = m.user_id AND e.event_id = m.id),
x AS (SELECT event_type = 'error' AS skipped, value AS gen_time, event_id % 700 AS input_tokens, event_id % 300 AS output_tokens, event_id % 3 = 0 AS hit_max FROM l)
SELECT COUNT(*) AS n, COUNT(*) FILTER (skipped) AS n_skipped, ROUND(AVG(gen_time) FILTER (NOT skipped), 4) AS mean_gen_time, ROUND(AVG(input_tokens) FILTER (NOT skipped), 4) AS mean_input_tokens,
 ROUND(AVG(output_tokens) FILTER (NOT skipped), 4) AS mean_output_tokens, COUNT(*) FILTER (hit_max) AS n_hit_max FROM x""")
def run_log_means(s, d):
    last = records.last_by(table(s, d, "events"), "user_id", "event_id")
    return records.run_means(last.select(
        (F.col("event_type") == "error").alias("skipped"), F.col("value").alias("gen_time"), (F.col("event_id") % 700).alias("input_tokens"),
        (F.col("event_id") % 300).alias("output_tokens"), (F.col("event_id") % 3 == 0).alias("hit_max"),
    ))


@query("""SELECT s.doc_id, s.split, l.quality, m.n AS n_log, d.source FROM fx_split s LEFT JOIN labels l ON s.doc_id = l.doc_id LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) m ON s.doc_id = m.user_id LEFT JOIN documents d ON s.doc_id = d.doc_id""")
def documents_with_sources_and_log(s, d):
    log = table(s, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n_log"))
    own = fixture(s, d, "fx_split").select("doc_id", "split").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return own.join(log, "doc_id", "left").join(table(s, d, "documents").select("doc_id", "source"), "doc_id", "left")


CONFIRM = """e AS (SELECT user_id AS document_id, ['product_name', 'signal_word', 'ingredients', 'ghs_classification', 'hazard_statements'][event_id % 5 + 1] AS field_path, CASE WHEN value < 20 THEN 'unconfirm' ELSE 'confirm' END AS action, event_id AS id FROM events),
m AS (SELECT document_id, field_path, arg_max(action, id) AS action FROM e GROUP BY ALL)"""


@query(f"""WITH {CONFIRM} SELECT document_id, COALESCE(string_agg(field_path, ',' ORDER BY field_path) FILTER (action = 'confirm'), '') AS fields, COUNT(*) FILTER (action = 'confirm') = 5 AS complete FROM m GROUP BY document_id""")
def confirmed_fields(s, d):
    names = ["product_name", "signal_word", "ingredients", "ghs_classification", "hazard_statements"]
    field = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 5).cast("int"))
    action = F.when(F.col("value") < 20, "unconfirm").otherwise("confirm")
    events = table(s, d, "events").select(F.col("user_id").alias("document_id"), field.alias("field_path"), action.alias("action"), F.col("event_id").alias("id"))
    return review.confirmed_fields(events)


@query("""SELECT event_id AS document_id, event_type AS field_path, 'confirm' AS action FROM events WHERE event_id % 4 = 0 AND value > 50 AND user_id % 5 <> 0 AND user_id % 7 <> 0""")
def bulk_confirmed(s, d):
    status = F.when(F.col("event_id") % 4 == 0, "OK").otherwise("REVIEW_REQUIRED")
    own = table(s, d, "events").select(
        F.col("event_id").alias("document_id"), F.col("event_type").alias("field_path"), status.alias("status"), (F.col("value") > 50).alias("has_evidence"),
        F.lit(False).alias("pending"), (F.col("user_id") % 5 == 0).alias("confirmed"), (F.col("user_id") % 7 == 0).alias("reviewed"),
    )
    return review.bulk_confirm(own)


@query(r"""WITH i AS (SELECT doc_id, string_agg('{"name":"' || name || '","cas":' || COALESCE('"' || cas || '"', 'null') || '}', ',' ORDER BY seq) AS items FROM fx_gold_ing GROUP BY doc_id)
SELECT j.doc_id, CASE WHEN j.doc_id % 11 <> 0 THEN '{"ingredients":[' || COALESCE(items, '') || '],"list_status":' || regexp_extract(json, '"list_status":(\{[^}]*\})', 1) || '}' END AS record FROM fx_json j LEFT JOIN i ON j.doc_id = i.doc_id""")
def rebuilt_records(s, d):
    return records.rebuilt(fixture(s, d, "fx_json"), {"ingredients": fixture(s, d, "fx_gold_ing").select("doc_id", "seq", "name", "cas")}, "doc_id", "json")


@query("""WITH h AS (SELECT sha256(CAST(event_id AS VARCHAR) || chr(9) || props) AS h FROM events), p AS (SELECT substring(h, 1, 3) AS prefix, COUNT(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS part FROM h GROUP BY 1)
SELECT CAST(SUM(n) AS BIGINT) AS n, substring(sha256(string_agg(prefix || ':' || part, chr(10) ORDER BY prefix)), 1, 16) AS stamp FROM p""")
def results_bundle(s, d):
    return records.bundle(table(s, d, "events"), "event_id", "props")


@query("""SELECT conv_id, turn, '[{"role":"system","content":"Answer."},{"role":"user","content":"q1"},{"role":"assistant","content":"a1"},{"role":"user","content":' || to_json(trim(text)) || '}]' AS messages FROM conversations""")
def prompt_messages(s, d):
    shots = s.createDataFrame([(1, " q1 ", "a1")], "place int, text string, answer string")
    docs = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return governance.messages("Answer.", shots, docs).select("doc_id.conv_id", "doc_id.turn", F.to_json("messages").alias("messages"))
