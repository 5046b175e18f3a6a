"""Validation, deduplication, merging, entity resolution and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.catalog.scans import _HOST
from siftwork.functions.text import fold, similarity
from siftwork.operators import check, clean, match, score
from siftwork.operators.store import settled
from siftwork.plans.model import Field, MatchRule, Plan, Rule
from siftwork.sources.tables import spread

#: Orders as records whose defects depend on the key: missing, mistyped and malformed values.
ORDERS = Plan(
    (
        Field("company_name", required=True), Field("website", format="uri"), Field("email", format="email"), Field("founded_date", format="date"),
        Field("category", enum=("O", "F")), Field("employees", "integer"), Field("country"),
    ),
    rules=(Rule("RANGE", "employees", "WARNING", "Employees out of range.", 0, 300000), Rule("CUSTOM", "category", "ERROR", "looks right"), Rule("REQUIRED", "email", "WARNING", "Email expected.")),
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = k.cast("string")
    return spread(table(spark, sf_dir, "orders")).select(
        k.alias("rec_idx"), F.when(k % 11 != 0, F.array(F.concat(F.lit("https://o.example.com/"), text))).otherwise(F.array().cast("array<string>")).alias("source_urls"),
        F.when(k % 5 != 0, F.concat(F.lit("Order "), text)).alias("company"), F.when(k % 7 == 0, "ftp://x.example.com/").otherwise("x.example.com/a/").alias("url"),
        F.when(k % 3 == 0, "not an email").when(k % 3 == 1, F.concat(F.lit("O"), text, F.lit("@Example.com"))).alias("e-mail"), F.when(k % 4 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("founded"),
        F.col("o_orderstatus").alias("category"), F.when(k % 6 == 0, "many").otherwise(F.floor("o_totalprice").cast("string")).alias("employees"), F.when(k % 2 == 0, "de").otherwise("Nowhere Land").alias("country"),
    )


_ISSUES = """i AS (
SELECT o_orderkey AS rec_idx, CAST(NULL AS VARCHAR) AS field, 'SOURCE_EVIDENCE' AS rule, 'ERROR' AS severity FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 'company_name', 'REQUIRED', 'ERROR' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'website', 'URL', 'ERROR' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'email', 'EMAIL', 'ERROR' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'email', 'REQUIRED', 'WARNING' FROM orders WHERE o_orderkey % 3 = 2
UNION ALL SELECT o_orderkey, 'founded_date', 'DATE', 'ERROR' FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'category', 'ENUM', 'ERROR' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'employees', 'TYPE', 'ERROR' FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey, 'employees', 'RANGE', 'WARNING' FROM orders WHERE o_orderkey % 6 <> 0 AND floor(o_totalprice) > 300000
UNION ALL SELECT o_orderkey, 'country', 'COUNTRY', 'WARNING' FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT o_orderkey, 'category', 'CUSTOM', 'WARNING' FROM orders)"""


@query(f"WITH {_ISSUES} SELECT rec_idx, field, rule, severity FROM i")
def v1_to_v10_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.issue_table(check.validate(clean.normalize(_orders(spark, sf_dir), ORDERS), ORDERS)).select("rec_idx", "field", "rule", "severity")


@query(f"""WITH {_ISSUES}, r AS (SELECT o_orderkey AS rec_idx, count(*) FILTER (WHERE severity = 'ERROR') AS e FROM orders LEFT JOIN i ON rec_idx = o_orderkey GROUP BY o_orderkey)
SELECT (SELECT count(*) FROM i) AS issues, (SELECT count(*) FROM i WHERE severity = 'ERROR') AS errors, (SELECT count(*) FROM i WHERE severity = 'WARNING') AS warnings,
count(*) FILTER (WHERE e = 0) AS valid, count(*) FILTER (WHERE e > 0) AS invalid, count(*) FILTER (WHERE rec_idx % 11 = 0) AS unsupported FROM r""")
def v11_v12_v13_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.summary(check.validate(clean.normalize(_orders(spark, sf_dir), ORDERS), ORDERS))


@query("""SELECT page_id AS rec_idx, CAST(CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS INT) AS n_verified, CASE WHEN page_id % 3 = 0 THEN 0.55 WHEN page_id % 3 = 1 THEN 0.45 ELSE 0.1 END::DOUBLE AS confidence FROM pages""")
def v1_v14_verified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited urls count if a tool saw them: a semi-join on their canonical form."""
    p = table(spark, sf_dir, "pages")
    own = F.concat(F.lit("https://v.example.com/"), F.col("page_id").cast("string"))
    k = F.col("page_id") % 3
    records = p.select(F.col("page_id").alias("rec_idx"), F.array(own, F.concat(own, F.lit("/b#x"))).alias("source_urls"), F.lit("x").alias("company"))
    sources = p.where(k < 2).select(F.concat(own, F.lit("/")).alias("url"), F.lit(True).alias("verified")).unionByName(p.select(F.concat(own, F.lit("/b")).alias("url"), (k == 0).alias("verified")))
    plan = Plan((Field("company_name"),))
    out = check.validate(clean.normalize(records, plan), plan, sources)
    return out.select("rec_idx", F.size("source_urls").alias("n_verified"), F.round("confidence", 6).alias("confidence"))


DOCS = Plan((Field("title"), Field("lang"), Field("site")), match_rules=(MatchRule(("title",)),), required=("title",))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as validated records, cited by their source."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"))
    rows = d.select(F.col("doc_id").alias("rec_idx"), F.array(url).alias("source_urls"), F.col("text").alias("title"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("site"))
    # matching reads its records several times, so they are written once, as in the pipeline
    return settled(check.validate(clean.normalize(rows, DOCS), DOCS))


_FOLD = "trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_DOCS = f"""d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 2 = 0 THEN source END AS site, nullif({_FOLD}, '') AS k FROM documents),
g AS (SELECT *, CASE WHEN k IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY k) END AS head FROM d)"""


@query(f"WITH {_DOCS} SELECT doc_id AS rec_idx, CASE WHEN head < doc_id THEN head END AS duplicate_of FROM g")
def d1_d4_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _docs(spark, sf_dir)
    return records.select("rec_idx").join(match.links(records, DOCS).drop("rule"), "rec_idx", "left")


@query(f"""WITH {_DOCS}, h AS (SELECT g.*, first_value(site IGNORE NULLS) OVER w AS any_site, first_value(source) OVER w AS s0, first_value(lang) OVER w AS l0, first_value(site IGNORE NULLS) OVER (PARTITION BY head ORDER BY doc_id) AS so_far, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY head ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT head, sum(CASE WHEN site IS NOT NULL AND {{}} THEN 1 ELSE 0 END) + sum(CASE WHEN lang <> l0 THEN 1 ELSE 0 END) AS n_conflicts, count(DISTINCT source) AS n_urls FROM h GROUP BY head)
SELECT h.doc_id AS rec_idx, CASE WHEN h.doc_id = h.head THEN h.any_site ELSE h.site END AS site, CASE WHEN h.doc_id = h.head THEN c.n_urls ELSE 1 END AS n_urls, CAST(CASE WHEN h.doc_id = h.head AND n > 1 THEN c.n_conflicts ELSE 0 END AS BIGINT) AS n_conflicts FROM h JOIN c USING (head)""".replace("{}", "lower(site) <> lower(so_far)"))
def d6_d7_d8_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows take what they lack, unite the urls and keep what differs."""
    merged, _ = match.deduplicate(_docs(spark, sf_dir), DOCS)
    return merged.select("rec_idx", "values.site", F.size("source_urls").cast("long").alias("n_urls"), F.size("conflicts").cast("long").alias("n_conflicts"))


@query(f"""WITH {_DOCS} SELECT head AS canonical_idx, doc_id AS duplicate_idx, 'MERGED' AS decision, 'NORMALIZED' AS match_type, 0.99::DOUBLE AS confidence FROM g WHERE head < doc_id""")
def d10_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links tell; no record is merged for it."""
    return match.key_events(match.links(_docs(spark, sf_dir), DOCS), DOCS).drop("matched_fields")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS rec, p_brand || chr(31) || p_size || chr(31) || p_type AS a, lower(p_type) || chr(31) || p_size AS b FROM part),
r AS (SELECT 0 AS k, rec, a, b, 0 AS status FROM p UNION ALL SELECT k + 1, rec, a, b, CASE WHEN status > 0 THEN status WHEN win THEN 1 WHEN bool_or(win) OVER (PARTITION BY a) OR bool_or(win) OVER (PARTITION BY b) THEN 2 ELSE 0 END
FROM (SELECT *, status = 0 AND rec = min(rec) FILTER (status = 0) OVER (PARTITION BY a) AND rec = min(rec) FILTER (status = 0) OVER (PARTITION BY b) AS win, bool_or(status = 0) OVER () AS going FROM r) WHERE going),
f AS (SELECT rec, a, b FROM r WHERE status = 1 AND k = (SELECT max(k) FROM r))
SELECT p.rec AS rec_idx, coalesce(x.rec, y.rec) AS duplicate_of, CAST(CASE WHEN x.rec IS NULL THEN 1 ELSE 0 END AS INT) AS rule FROM p LEFT JOIN f x ON x.a = p.a AND x.rec < p.rec LEFT JOIN f y ON y.b = p.b AND y.rec < p.rec WHERE coalesce(x.rec, y.rec) IS NOT NULL""")
def d5_several_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules, exact and normalised: only unmatched records register their keys, so matches aren't transitive."""
    plan = Plan((Field("brand"), Field("size"), Field("type")), match_rules=(MatchRule(("brand", "size", "type"), "EXACT"), MatchRule(("type", "size"))))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_idx"), F.array().cast("array<string>").alias("source_urls"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"), F.col("p_type").alias("type"))
    return match.links(clean.normalize(parts, plan), plan)


@query("""SELECT part.p_partkey, '{"a":"' || p_brand || '","b":"' || p_size || '"}' AS stable FROM part""")
def d9_stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("b"), F.col("p_size").cast("string"), F.lit("a"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", match.stable_json(m, "map<string,string>").alias("stable"))


SUPPLIERS = Plan((Field("company_name"), Field("website"), Field("email")), match_rules=(MatchRule(("company_name",), "FUZZY_REVIEW", 0.93),))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    site = F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".example.com/"))
    rows = s.select(F.col("s_suppkey").alias("rec_idx"), F.array(site).alias("source_urls"), F.concat(F.col("s_name"), F.lit(" Ltd.")).alias("company"), site.alias("url"), F.lit(None).cast("string").alias("email"))
    return clean.normalize(rows, SUPPLIERS)


_NAMES = "n AS (SELECT s_suppkey, s_nationkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')) AS name FROM supplier)"
_PAIRS = f"""{_NAMES}, p AS (SELECT a.s_suppkey AS left_idx, b.s_suppkey AS right_idx, a.s_nationkey = b.s_nationkey AS shared, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE AS confidence
FROM n a JOIN n b ON a.s_suppkey < b.s_suppkey AND (substr(a.name, 1, 2) = substr(b.name, 1, 2) OR a.s_nationkey = b.s_nationkey)), q AS (SELECT * FROM p WHERE confidence >= 0.93)"""


@query(f"WITH {_PAIRS} SELECT left_idx, right_idx, shared, round(confidence, 6) AS confidence FROM q")
def d13_d14_d15_d16_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in one block that are similar enough, and whether they share an identifier."""
    return match.similar_pairs(match._named(_suppliers(spark, sf_dir), SUPPLIERS), 0.93).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH RECURSIVE {_PAIRS}, n2 AS (SELECT right_idx AS i, list(left_idx) AS lowers, row_number() OVER (ORDER BY right_idx) AS k FROM q WHERE shared GROUP BY right_idx),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT n2.k, CASE WHEN len(list_filter(lowers, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, i) ELSE gone END FROM g JOIN n2 ON n2.k = g.k + 1)
SELECT left_idx AS canonical_idx, right_idx AS duplicate_idx, CASE WHEN shared THEN 'MERGED' ELSE 'REVIEW_REQUIRED' END AS decision, round(confidence, 6) AS confidence
FROM q, (SELECT gone FROM g ORDER BY k DESC LIMIT 1) WHERE NOT list_contains(gone, left_idx) QUALIFY row_number() OVER (PARTITION BY right_idx ORDER BY shared DESC, confidence DESC, left_idx) = 1""")
def d17_d18_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges depend on the merges before them: the SQL goes through the names in order."""
    _, events = match.resolve(_suppliers(spark, sf_dir), SUPPLIERS)
    return events.select("canonical_idx", "duplicate_idx", "decision", F.round("confidence", 6).alias("confidence"))


@query("""SELECT count(*) AS n, count(DISTINCT url) AS urls, max(seq) AS last FROM (SELECT 'https://' || source || '.example.com/' AS url, doc_id AS seq FROM documents UNION ALL SELECT url, page_id FROM pages)""")
def d19_merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/")).alias("url"), F.col("doc_id").alias("seq"))
    both = d.unionByName(table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("seq")))
    last = both.groupBy("url").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    return last.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("urls"), F.max("seq").alias("last"))


@query("""SELECT DISTINCT o_custkey FROM orders""")
def d20_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").dropDuplicates(["o_custkey"]).select("o_custkey")


_SCORED = f"""WITH {_DOCS}, u AS (SELECT head, count(*) AS n, count(DISTINCT source) AS hosts, sum(CASE WHEN lang <> l0 THEN 1 ELSE 0 END) + sum(CASE WHEN site IS NOT NULL AND lower(site) <> lower(so_far) THEN 1 ELSE 0 END) AS conflicts FROM
(SELECT *, first_value(lang) OVER w AS l0, first_value(site IGNORE NULLS) OVER (PARTITION BY head ORDER BY doc_id) AS so_far FROM g WINDOW w AS (PARTITION BY head ORDER BY doc_id)) GROUP BY head),
s AS (SELECT g.doc_id, g.head, CASE WHEN g.doc_id = g.head THEN u.conflicts ELSE 0 END AS conflicts, CASE WHEN g.doc_id = g.head THEN u.hosts ELSE 1 END AS hosts FROM g JOIN u USING (head)),
c AS (SELECT doc_id, head, conflicts, least(0.95, greatest(0.05, 0.35 + least(0.2, (hosts - 1) * 0.1) + 0.25 + 0.15 - least(0.25, conflicts * 0.1)))::DOUBLE AS confidence FROM s)"""


@query(f"""{_SCORED} SELECT doc_id AS rec_idx, round(confidence, 6) AS confidence, CASE WHEN conflicts > 0 THEN 'CONFLICTED' ELSE 'SOURCE_CITED_UNVERIFIED' END AS state, round(least(0.7, confidence), 6) AS lang_confidence FROM c""")
def q1_to_q5_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _ = match.deduplicate(_docs(spark, sf_dir), DOCS)
    out = score.assess(merged, DOCS)
    return out.select("rec_idx", F.round("confidence", 6).alias("confidence"), "state", F.round(F.col("fields")["lang"]["confidence"], 6).alias("lang_confidence"))


@query(f"""{_SCORED} SELECT count(*) AS raw_records, count(*) AS source_backed, count(*) FILTER (WHERE doc_id = head) AS valid, count(*) FILTER (WHERE doc_id > head) AS duplicates, CAST(sum(conflicts) AS BIGINT) AS conflicts, floor(avg(confidence) FILTER (WHERE doc_id = head) * 10000 + 0.5) / 10000 AS quality_score FROM c""")
def q6_q8_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, events = match.deduplicate(_docs(spark, sf_dir), DOCS)
    return score.metrics(score.assess(merged, DOCS), events).select("raw_records", "source_backed", "valid", "duplicates", "conflicts", "quality_score")


@query(f"""WITH {_ISSUES}, r AS (SELECT o_orderkey AS k, count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity = 'WARNING') AS w FROM orders LEFT JOIN i ON rec_idx = o_orderkey GROUP BY o_orderkey),
c AS (SELECT *, CASE WHEN k % 11 = 0 THEN 0.05 ELSE least(0.95, greatest(0.05, 0.35 + CASE WHEN k % 5 <> 0 THEN 0.25 ELSE 0 END + CASE WHEN e = 0 THEN 0.15 ELSE 0 END - least(0.2, w * 0.025))) END::DOUBLE AS confidence FROM r)
SELECT count(*) AS raw_records, count(*) AS normalized_records, count(*) FILTER (k % 11 <> 0) AS source_backed, count(*) FILTER (k % 11 = 0) AS unsupported, count(*) FILTER (e = 0) AS valid, count(*) FILTER (e > 0) AS invalid, 0 AS duplicates, 0 AS conflicts,
CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings, floor(avg(confidence) * 10000 + 0.5) / 10000 AS mean_confidence, floor(avg(confidence) * 10000 + 0.5) / 10000 AS quality_score, 0 AS review_required FROM c""")
def q7_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on the orders' records: one row of metrics."""
    return score.process(_orders(spark, sf_dir), ORDERS).metrics


@query(f"""SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS hosts, {_HOST} AS host FROM pages""")
def q3_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.functions import urls

    own = F.array(F.col("url"), F.col("url"), F.when(F.col("page_id") % 2 == 0, "https://other.example.org/").otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", score.domains(own).alias("hosts"), urls.host(F.col("url")).alias("host"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' WHEN o_orderkey % 3 = 1 THEN 'PARTIAL' ELSE 'READY' END AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'COMPLETED' WHEN o_orderkey % 3 = 1 THEN 'PARTIAL' ELSE 'PARTIAL' END AS result FROM orders""")
def q9_q15_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", score.dataset_status(k, F.lit(2)).alias("dataset"), score.result_status(k, F.lit(5)).alias("result"))


@query(f"""SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b), 1)::DOUBLE END, 6) AS similarity FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)""")
def d15_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(similarity(F.lower("p_name"), F.lower("p_type")), 6).alias("similarity"))


@query("SELECT doc_id, doc_id % 2 = 0 AS same FROM documents")
def d7_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("text")) == fold(F.concat(F.lit(" ¡"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, "!").otherwise("x")))).alias("same"))
