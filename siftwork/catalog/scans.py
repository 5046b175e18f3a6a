"""Scans, readers of loosely shaped JSON, and generated sources."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.operators.query import export_columns
from siftwork.plans.model import Field, Plan
from siftwork.sources import fixtures, payloads, sinks, tables


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def s1_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])
    return rows.where("l_returnflag = 'R' AND l_quantity > 45").drop("l_returnflag")


def _events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool output made of the events' own JSON; every seventh text is cut off and so not JSON."""
    whole = F.concat(F.lit('{"records":[{"values":'), F.col("props"), F.lit(',"sourceUrls":["https://e.example.com/'), F.col("event_id").cast("string"), F.lit('"]},{"values":{}}]}'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("payload"))


@query("""SELECT event_id AS id, 0 AS pos, json_extract_string(props, '$.k') AS k, 'https://e.example.com/' || event_id AS url FROM events WHERE event_id % 7 <> 0""")
def s2_s9_record_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.records(_events_json(spark, sf_dir)).select("id", "pos", F.col("values")["k"].alias("k"), F.col("source_urls")[0].alias("url"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.lit(1).alias("run"), F.col("page_id").alias("seq"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"
_QUERY = "list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^({drop})$')))"
TRACKING = "utm_.+|gclid|fbclid|mc_cid|mc_eid"
SECRET = "token|access_token|api_key|apikey|key|session|sessionid|auth"


def sql_form(drop: str, host: str = _HOST) -> str:
    q = _QUERY.format(drop=drop)
    return f"regexp_extract(url, '^([a-z]+)://', 1) || '://' || {host} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END"


SOURCE_FORM = sql_form(f"{TRACKING}|{SECRET}")


@query(f"""WITH f AS (SELECT page_id, {SOURCE_FORM} AS canonical_url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT 1 AS run, canonical_url, min(page_id) AS seq, arg_min(title, page_id) FILTER (WHERE title <> '') AS title, count(*) AS seen FROM f GROUP BY canonical_url""")
def s3_collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.collect_sources(_found(spark, sf_dir))


def _search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.to_json(F.struct(F.concat(F.lit("https://o.example.com/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("snippet")))
    image = F.to_json(F.struct(F.lit("https://i.example.com/").alias("imageUrl"), F.lit("seen").alias("answer")))
    nested = F.concat(F.lit('{"data":{"web":['), row, F.lit(',{"note":1}],"images":['), image, F.lit("]}}"))
    flat = F.concat(F.lit("["), row, F.lit("]"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, nested).otherwise(flat).alias("payload"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'web' END AS category, 'https://o.example.com/' || o_orderkey AS url, o_orderpriority AS title, o_orderstatus AS description FROM orders
UNION ALL SELECT o_orderkey, 'images', 'https://i.example.com/', '', 'seen' FROM orders WHERE o_orderkey % 2 = 0""")
def s4_s5_search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.search_rows(_search_json(spark, sf_dir)).select("id", "category", "url", "title", "description")


@query("""SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n_chars, CAST(200 AS INT) AS status, 2 AS n_links FROM pages""")
def s6_page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    meta = F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("ogTitle"), F.lit(200).alias("statusCode"))
    links = F.array(F.to_json(F.struct(F.col("url"))), F.to_json(F.struct(F.lit("").alias("none"))), F.concat(F.lit('"'), F.lit("https://x.example.com/"), F.lit('"')))
    body = F.to_json(F.struct(F.struct(F.col("url"), F.col("html").alias("markdown"), meta.alias("metadata")).alias("data")))
    payload = F.concat(F.lit('{"links":['), F.array_join(links, ","), F.lit("],"), F.substring(body, 2, 1 << 30))
    rows = payloads.page_rows(p.select(F.col("page_id").alias("id"), payload.alias("payload")))
    return rows.select("id", "url", "title", F.length("markdown").cast("long").alias("n_chars"), "status", F.size("links").alias("n_links"))


@query("""SELECT page_id AS id, CAST(0 AS INT) AS pos, url, CASE WHEN page_id % 3 = 0 THEN 'error' WHEN page_id % 3 = 1 THEN 'empty' ELSE 'loaded' END AS state, CAST(page_id % 2 AS INT) AS exit_code FROM pages""")
def s7_s8_shell_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    error = F.when(F.col("page_id") % 3 == 0, "boom")
    one = F.to_json(F.struct(F.col("url"), error.alias("error"), F.when(F.col("page_id") % 3 == 2, 5).otherwise(0).alias("bytes")))
    loads = p.select(F.col("page_id").alias("id"), F.concat(F.lit('{"pages":['), one, F.lit("]}")).alias("payload"))
    runs = p.select(F.col("page_id").alias("id"), F.to_json(F.struct(F.lit("ok").alias("stdout"), (F.col("page_id") % 2).alias("exitCode"))).alias("payload"))
    return payloads.load_rows(loads).select("id", "pos", "url", "state").join(payloads.exec_rows(runs).select("id", "exit_code"), "id")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'text' END AS k FROM events""")
def s10_coerced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    field = F.when(F.col("event_id") % 2 == 0, quoted).otherwise(F.lit('"text"'))
    made = payloads.coerced(field)
    return e.select("event_id", F.coalesce(F.get_json_object(made, "$.k"), F.lit("text")).alias("k"))


@query("""SELECT i AS rec_idx, 'Job ' || printf('%03d', i + 1) AS name, 'https://job-' || printf('%03d', i + 1) || '.example.com' AS website, 'job' AS kind FROM (SELECT unnest(generate_series(0, 39)) AS i)""")
def s11_s12_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.generated(spark, "Find 40 hiring teams").drop("source_urls")


@query("""SELECT i AS rec_idx, 'Channel ' || printf('%03d', i + 1) AS channel_name, ((i + 1) * 10) || 'K' AS subscribers, ['algorithms', 'web development', 'systems', 'data'][i % 4 + 1] AS primary_topics, 'https://list-' || i % 3 || '.example.com/' AS source_url FROM (SELECT unnest(generate_series(0, 19)) AS i)""")
def s12_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = "The 20 best coding channels"
    assert fixtures.template(prompt) == "channel"
    return fixtures.channels(spark, prompt).select("rec_idx", "channel_name", "subscribers", "primary_topics", "source_url")


@query("""SELECT 'd' || n_regionkey || '.example.com' AS domain, lpad(CAST(max(n_nationkey) AS VARCHAR), 3, '0') AS slug, 'second' AS playbook FROM nation GROUP BY n_regionkey""")
def s13_domain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several skills name a domain, in two playbooks each and in other cases: the last one counts."""
    d = F.concat(F.lit("D"), F.col("n_regionkey").cast("string"), F.lit(".Example.com"))
    books = F.array(F.struct(F.lit("first").alias("playbook"), F.array(d, F.upper(d)).alias("domains")), F.struct(F.lit("second").alias("playbook"), F.array(F.lower(d)).alias("domains")))
    return fixtures.domain_index(table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("slug"), books.alias("playbooks")))


@query("""SELECT n_nationkey, lower(n_name) AS name, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS slug, 'Body of ' || n_name AS body FROM nation""")
def s13_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    files = n.select("n_nationkey", F.concat(F.lit("---\nname: "), F.lower("n_name"), F.lit('\ndescription: "A nation"\n---\nBody of '), F.col("n_name")).alias("value"))
    return fixtures.front_matter(files).select("n_nationkey", "name", "slug", "body")


@query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 500")
def s14_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.history(table(spark, sf_dir, "events"), "purchase", 500, "event_type", "event_id").select("event_id", "event_type", "ts")


@query("""SELECT n_nationkey, regexp_replace(substr(t, 1, 30), '-+$', '') || '-' || substr(sha256(n_name), 1, 8) || '.csv' AS file FROM (SELECT *, trim(regexp_replace(lower(n_name || ' of region number ' || n_regionkey || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS t FROM nation)""")
def x5_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("n_name", F.lit(" of region number "), F.col("n_regionkey").cast("string"), F.lit("!"))
    return table(spark, sf_dir, "nation").select("n_nationkey", sinks.file_name_of(title, F.sha2("n_name", 256), "csv").alias("file"))


@query("""SELECT part_no AS part, count(*) AS rows, CAST(sum(strlen(line) + 2) AS BIGINT) AS size FROM (SELECT o_orderkey % 4 AS part_no, o_orderkey || ',' || o_orderstatus AS line FROM orders) GROUP BY part_no""")
def x4_counts_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of files that aren't written yet, from their lines."""
    o = table(spark, sf_dir, "orders")
    lines = o.select((F.col("o_orderkey") % 4).alias("part"), F.concat_ws(",", *[sinks.csv_cell(F.col(c), t) for c, t in o.select("o_orderkey", "o_orderstatus").dtypes]).alias("line"))
    return lines.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("line") + 2).cast("long").alias("size"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS row, n AS cell, v AS text FROM (SELECT n_nationkey, unnest(['A', 'B', 'C']) AS n, unnest([CAST(n_nationkey AS VARCHAR), n_name, CASE WHEN n_regionkey > 1 THEN '1' ELSE '0' END]) AS v FROM nation)""")
def x3_sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook written and read back: number, text and boolean cells."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", (F.col("n_regionkey") > 1).alias("high"))
    with tempfile.TemporaryDirectory() as folder:
        done = sinks.export(n, folder, "Nations", "x3", "xlsx")
        with zipfile.ZipFile(done["path"]) as z:
            sheet = z.read("xl/worksheets/sheet1.xml").decode()
    cells = re.findall(r'<c r="([A-Z]+)(\d+)"[^>]*>(?:<v>|<is><t[^>]*>)([^<]*)', sheet)
    rows = [(int(at) - 2, name, value) for name, at, value in cells if at != "1"]
    return spark.createDataFrame(rows, "row long, cell string, text string")


@query("""SELECT * FROM (VALUES ('csv', 'COMPLETED', 25, true), ('json', 'COMPLETED', 25, true), ('broken', 'FAILED', NULL, false), ('outside', 'FAILED', NULL, false)) t(job, status, rows, there)""")
def x6_x7_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export jobs that end well, fail while they write, and try to leave the folder; a failed one leaves no file."""
    n, out = table(spark, sf_dir, "nation"), []
    with tempfile.TemporaryDirectory() as folder:
        for job, df, kind in (("csv", n, "csv"), ("json", n, "json"), ("broken", n.select(F.raise_error(F.lit("lost")).alias("x")), "csv")):
            done = sinks.export(df, folder, f"Job {job}", job, kind)
            out.append((job, done["status"], done.get("rows"), any(job in x for x in os.listdir(folder))))
        try:
            sinks.contained(folder, "../outside")
            out.append(("outside", "COMPLETED", None, True))
        except PermissionError:
            out.append(("outside", "FAILED", None, os.path.exists(f"{folder}/../outside")))
    return spark.createDataFrame(out, "job string, status string, rows int, there boolean")


_CELL = "CASE WHEN regexp_matches({0}, '[,\"\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"""SELECT doc_id || ',' || {_CELL.format('text')} || ',' || {_CELL.format('lang')} || ',' AS line FROM documents""")
def x1_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.lit(None).cast("string").alias("none")))


@query("""SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","none":null}' AS line FROM orders""")
def x2_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("none")))


@query("""SELECT '"' || n_nationkey || '","' || n_name || '",""' AS line FROM nation""")
def x8_quoted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")), always=True)


@query("SELECT p_partkey, p_name, p_size FROM part")
def j8_export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan((Field("p_partkey", "integer"), Field("p_name"), Field("p_size", "integer"), Field("p_brand")))
    return table(spark, sf_dir, "part").select(*export_columns(["p_size", "p_name", "p_partkey", "unknown"], plan))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x.y' ELSE 'k,x.y' END AS missing, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'z' END AS extra FROM events""")
def v15_v16_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a record's JSON lacks, and keys that its closed schema doesn't know."""
    doc = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit('{"z":1}'))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(payloads.missing_paths(doc, ["k", "x.y"]), ",").alias("missing"), F.array_join(payloads.extra_keys(doc, ["k", "x"]), ",").alias("extra"))


@query("""SELECT * FROM (VALUES ('companies', 106, 102, 1, 3, 1), ('jobs', 32, 30, 0, 2, 1), ('sponsors', 27, 25, 0, 2, 1)) t(scenario, raw_records, valid, invalid, duplicates, conflicts)""")
def s11_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo scenarios through the whole pipeline: a row of metrics each."""
    from siftwork.operators import score

    out = None
    for name, s in fixtures.SCENARIOS.items():
        m = score.process(s.records(spark), s.plan).metrics
        row = m.select(F.lit(name).alias("scenario"), *[F.col(c).cast("int") for c in ("raw_records", "valid", "invalid", "duplicates", "conflicts")])
        out = row if out is None else out.unionByName(row)
    return out
