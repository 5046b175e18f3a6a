"""Dataset queries: filters, searches, pages, counts and nested views over orders, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.operators import query as q
from siftwork.operators import runs
from siftwork.plans.model import Field, Plan


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 11 AND c_mktsegment = 'BUILDING')")
def p1_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("workspace_id"), F.when(F.col("c_mktsegment") == "BUILDING", "ACTIVE").otherwise("LEFT").alias("status"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("workspace_id"))
    return q.tenant(rows, members, 11).select("o_orderkey")


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as dataset rows: confidence from the discount, duplicates and states from other columns."""
    li = table(spark, sf_dir, "lineitem")
    values = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("double").alias("line"), F.col("l_linestatus").alias("status"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_idx"), values.alias("values"), (F.col("l_tax") < 0.07).alias("is_valid"), F.when(F.col("l_quantity") > 40, F.col("l_orderkey")).alias("duplicate_of"),
        F.when(F.col("l_discount") > 0.05, "CONFLICTED").otherwise("UNSUPPORTED").alias("state"), F.round(F.col("l_discount") * 10, 4).alias("confidence"), F.col("l_suppkey").alias("source"),
    )


_ROWS = """r AS (SELECT l_orderkey * 10 + l_linenumber AS rec_idx, l_returnflag AS flag, CAST(l_linenumber AS DOUBLE) AS line, l_linestatus AS status, l_tax < 0.07 AS is_valid, CASE WHEN l_quantity > 40 THEN l_orderkey END AS duplicate_of,
CASE WHEN l_discount > 0.05 THEN 'CONFLICTED' ELSE 'UNSUPPORTED' END AS state, round(l_discount * 10, 4) AS confidence, l_suppkey AS source FROM lineitem)"""


@query(f"WITH {_ROWS} SELECT rec_idx, confidence FROM r WHERE is_valid AND duplicate_of IS NOT NULL AND state = 'CONFLICTED' AND confidence BETWEEN 0.6 AND 0.9 ORDER BY confidence DESC, rec_idx LIMIT 200 OFFSET 200")
def p2_p3_l1_l4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = q.RowQuery(valid_only=True, duplicates_only=True, state="CONFLICTED", min_confidence=0.6, max_confidence=0.9, page=2, size=500)
    return q.rows(_dataset(spark, sf_dir), wanted, []).select("rec_idx", "confidence")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thnd') OR contains(lower(source), 'thnd')")
def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(q.contains_any("THND", F.col("text"), F.col("source"))).select("doc_id")


@query(f"WITH {_ROWS} SELECT rec_idx FROM r WHERE flag = 'R' AND line = 2")
def p5_p6_p7_l8_field_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan((Field("flag"), Field("line", "number"), Field("status", filterable=False)))
    wanted = q.RowQuery(filters=q.checked_filters({"flag": "R", "line": "2"}, plan))
    return _dataset(spark, sf_dir).where(q.predicate(wanted, [])).select("rec_idx")


@query("""SELECT o_orderkey, c_name, n_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '000012') OR contains(lower(n_name), 'tion_7') OR contains(lower(o_orderpriority), 'tion_7')""")
def p8_p9_p10_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term over columns of three joined tables; here customers of one nation, and by a second term some names."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    columns = (F.col("c_name"), F.col("n_name"), F.col("o_orderpriority"))
    found = q.contains_any("tion_7", *columns) | q.contains_any("000012", *columns)
    return rows.where(found).select("o_orderkey", "c_name", "n_name", "o_orderpriority")


@query("""SELECT page_id FROM pages WHERE contains(lower(url), 'thth') OR contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'thth') OR contains(lower(html), 'href="/thth')""")
def p9_source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term in a source's address, title or text."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    link = F.when(F.lower("html").contains('href="/thth'), "thth")
    return table(spark, sf_dir, "pages").where(q.contains_any("ThTh", F.col("url"), title, link)).select("page_id")


@query("""SELECT o_orderkey, 'known' AS filter FROM orders WHERE o_orderstatus = 'F' AND (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high'))
UNION ALL SELECT o_orderkey, 'unknown' FROM orders WHERE contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg')""")
def p10_status_and_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status that isn't known is no filter, and no error."""
    orders = table(spark, sf_dir, "orders")
    columns = (F.col("o_orderpriority"), F.col("o_orderstatus"))
    of = lambda status, term, name: orders.where(q.known_status(F.col("o_orderstatus"), status, ("O", "F", "P")) & q.contains_any(term, *columns)).select("o_orderkey", F.lit(name).alias("filter"))
    return of("F", "High", "known").unionByName(of("lost", "URG", "unknown"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)")
def p11_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000 AND o_totalprice < 200000 AND o_totalprice BETWEEN 5000 AND 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND contains(lower(o_orderpriority), 'h') AND o_orderdate IS NOT NULL AND o_custkey > 5 AND o_custkey <= 100000""")
def p12_filter_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("o_orderstatus", "neq", "P"), ("o_totalprice", "gte", 1000), ("o_totalprice", "lt", 200000), ("o_totalprice", "between", (5000, 150000)), ("o_orderpriority", "in", ("1-URGENT", "2-HIGH")), ("o_orderpriority", "contains", "H"), ("o_orderdate", "exists", True), ("o_custkey", "gt", 5), ("o_custkey", "lte", 100000)]
    rows = table(spark, sf_dir, "orders")
    for column, op, value in rules:
        rows = rows.where(q.compare(F.col(column), op, value))
    return rows.select("o_orderkey")


@query("SELECT event_id, ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS inside, CAST(ts AS DATE) = DATE '2024-01-15' AS that_day FROM events")
def p13_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", q.time_range(ts, after="2024-01-10", before="2024-01-20").alias("inside"), q.time_range(ts, on="2024-01-15").alias("that_day"))


@query(f"WITH {_ROWS} SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM r GROUP BY 1")
def p19_confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).groupBy(q.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS bucket, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def p20_p21_run_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("CANCELLED")
    return table(spark, sf_dir, "orders").where("o_totalprice > 0").groupBy(runs.status_bucket(status).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, c_name, n_name, r_name, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j1_j2_j7_nested_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer with its nation, region and ordered list of orders; orders are gathered before the join."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("os"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(own, "c_custkey", "left")
    return rows.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce(F.array_join(F.transform("os", lambda x: x["o_orderkey"].cast("string")), ","), F.lit("")).alias("orders"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def j3_q10_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return q.with_count(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "n_orders")


@query("""SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_evidence, (SELECT arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_suppkey = s_suppkey) AS first_snippet, 'web' AS kind FROM supplier""")
def j4_source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.min_by("l_returnflag", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_snippet"))
    rows = table(spark, sf_dir, "supplier").join(own, "s_suppkey", "left")
    return rows.select("s_suppkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_evidence"), "first_snippet", F.coalesce(F.get_json_object(F.lit("{}"), "$.kind"), F.lit("web")).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS percent, CAST(90 AS BIGINT) AS unknown FROM lineitem")
def j5_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.percent(F.col("l_discount")).alias("percent"), q.percent(F.lit(None).cast("double")).alias("unknown"))


@query("SELECT o_orderkey, greatest(0, epoch_ms(max(l_shipdate)) - epoch_ms(o_orderdate)) AS ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def j6_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    return table(spark, sf_dir, "orders").join(last, "o_orderkey").select("o_orderkey", q.duration_ms(F.col("o_orderdate"), F.col("done"), F.col("o_orderdate")).alias("ms"))


@query("SELECT DISTINCT k FROM (SELECT unnest(json_keys(props)) AS k FROM events UNION ALL SELECT 'extra' FROM events WHERE event_id % 2 = 0)")
def j9_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    own = F.when(F.col("event_id") % 2 == 0, F.map_concat(m, F.create_map(F.lit("extra"), F.lit("1")))).otherwise(m)
    return table(spark, sf_dir, "events").select(F.explode(F.map_keys(own)).alias("k")).distinct()


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Stage started: ' || event_type WHEN 1 THEN 'Discovered source: 1 source' WHEN 2 THEN 'Extracted ' || user_id || ' records'
WHEN 3 THEN event_type || ' done' WHEN 4 THEN 'Said ' || event_type ELSE 'Deduplication complete: 0 duplicates identified' END AS message FROM events""")
def j10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    action = F.element_at(F.array(F.lit("STAGE_STARTED"), F.lit("SOURCE_DISCOVERED"), F.lit("RECORDS_COLLECTED"), F.upper(F.concat("event_type", F.lit("_DONE"))), F.lit("RUN_FAILED"), F.lit("DEDUP_COMPLETED")), (k + 1).cast("int"))
    none = F.lit(None).cast("string")
    details = F.map_from_arrays(
        F.array(F.lit("stage"), F.lit("count"), F.lit("message")),
        F.array(F.when(k == 0, F.col("event_type")).otherwise(none), F.col("user_id").cast("string"), F.when(k == 4, F.concat(F.lit("Said "), "event_type"))),
    )
    return table(spark, sf_dir, "events").select("event_id", runs.activity_message(action, details).alias("message"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q11_latest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", 1, "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10")
def q11_last_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", 10, "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey")
def q12_last_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))


@query("SELECT count(*) AS datasets, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS running, (SELECT count(*) FROM lineitem) AS records FROM orders")
def q13_q16_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("datasets"), F.count_if(F.col("o_orderstatus") == "O").alias("running"))
    return o.join(table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("records")))


@query("SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 200.0) AS BIGINT)) AS total_pages FROM orders WHERE o_orderstatus = 'P'")
def l2_l3_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.envelope(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), 500)


@query("SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, event_id LIMIT 100")
def l5_l6_l7_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return q.page(table(spark, sf_dir, "events"), 1, 100, F.desc(q.severity_rank(severity)), "event_id").select("event_id", "event_type")


@query("SELECT n FROM ((SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def l8_l9_l11_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf_dir, "supplier").select("s_nationkey")
    return c.intersect(s).exceptAll(table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey"))


@query("SELECT p_partkey, list_distinct(string_split(p_type || ' ' || p_name, ' ')) AS ignored, len(list_distinct(string_split(p_type || ' ' || p_name, ' '))) AS n FROM part".replace("list_distinct(string_split(p_type || ' ' || p_name, ' ')) AS ignored, ", ""))
def l10_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_name"), " "))).cast("long").alias("n"))
