"""Nested documents: lists of hits within lists, items of arrays, objects within objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.catalog.governance import _SCORED, DENIED, QUERIES, _candidates
from siftwork.operators import clean, match, nested
from siftwork.plans.model import Field, Plan, SourcePolicy

KEPT = 2
_IN_LISTS = _SCORED.split("b AS (")[0].rstrip().rstrip(",")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results that nest the pages of a range of ids in three lists, beside the properties of the event of that number."""
    hits = _candidates(spark, sf_dir).select((F.col("idx") - F.col("idx") % 12).alias("event_id"), (F.col("idx") % 3).alias("list"), F.struct(F.col("idx").alias("id"), "url", "title", F.col("snippet").alias("description")).alias("hit"))
    lists = hits.groupBy("event_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("list") == k, F.col("hit")))).alias(f"list{k}") for k in range(3)])
    said = [F.to_json(f"list{k}") for k in range(3)]
    payload = F.concat(F.lit('{"props":'), "props", F.lit(',"data":[['), said[0], F.lit(',[],{"web":'), said[1], F.lit('}],"none"],"x":{"y":{"z":["a",1,null'), F.when(said[2] != "[]", ",").otherwise(""), F.substring(said[2], F.lit(2), F.length(said[2]) - 1), F.lit("}}}"))
    return lists.join(table(spark, sf_dir, "events").select("event_id", "props"), "event_id").select("event_id", payload.alias("payload"))


@query(f"""WITH {_IN_LISTS}, p AS (SELECT idx - idx % 12 AS event_id, idx % 3 AS list, s.* FROM s WHERE points >= 120000 AND NOT (domain = '{DENIED[0]}' OR domain LIKE '%.{DENIED[0]}')),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY event_id, list, canonical ORDER BY points DESC, idx) = 1),
a AS (SELECT *, points - 80000 * (row_number() OVER (PARTITION BY event_id, list, domain ORDER BY points DESC, idx) - 1) AS adjusted FROM b),
c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY event_id, list ORDER BY adjusted DESC, points DESC, idx) <= {KEPT})
SELECT event_id, json_extract_string(props, '$.k') AS k, {", ".join(f"coalesce((SELECT string_agg(c.idx, ',' ORDER BY c.idx) FROM c WHERE c.event_id = e.event_id AND list = {k}), '') AS list{k}" for k in range(3))}, 3 AS others, 'none' AS tail
FROM events e WHERE event_id IN (SELECT page_id - page_id % 12 FROM pages)""")
def r7_nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of hits within nested results, each ranked by itself and written back in its place."""
    made = nested.filter_and_rank(_results(spark, sf_dir), QUERIES, KEPT, SourcePolicy(blocked=DENIED, preferred=("example.com",)))
    doc = F.try_parse_json("payload")
    ids = lambda path: F.array_join(F.filter(F.transform(F.try_variant_get(doc, path, "array<variant>"), lambda x: F.try_variant_get(x, "$.id", "string")), lambda x: x.isNotNull()), ",")
    deep = F.try_variant_get(doc, "$.x.y.z", "array<variant>")
    return made.select(
        "event_id", F.try_variant_get(doc, "$.props.k", "string").alias("k"), ids("$.data[0][0]").alias("list0"), ids("$.data[0][2].web").alias("list1"), ids("$.x.y.z").alias("list2"),
        F.size(F.filter(deep, lambda x: F.try_variant_get(x, "$.id", "string").isNull())).alias("others"), F.try_variant_get(doc, "$.data[1]", "string").alias("tail"),
    )


#: What an order's document should hold; each of its lines needs a flag and a place in a parcel.
ORDER = {"id": None, "customer": {"key": None, "note": None}, "lines": [{"n": None, "flag": None, "parcel": {"parts": [None]}}]}


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, nullif(l_returnflag, 'N') NULLS FIRST, [0, 2, 1][l_partkey % 3 + 1]) - 1 AS i FROM lineitem),
m AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'N' THEN 'lines[' || i || '].flag,' ELSE '' END || CASE l_partkey % 3 WHEN 0 THEN 'lines[' || i || '].parcel.parts[],' WHEN 1 THEN 'lines[' || i || '].parcel.parts[] (one or more items empty),' ELSE '' END, '' ORDER BY i) AS missing FROM l GROUP BY l_orderkey)
SELECT o_orderkey, rtrim(CASE WHEN o_custkey % 2 = 0 THEN 'customer.note,' ELSE '' END || coalesce(missing, 'lines[],'), ',') AS missing, CASE WHEN o_orderkey % 5 = 0 THEN 'status' ELSE '' END AS extra FROM orders LEFT JOIN m ON l_orderkey = o_orderkey""")
def v15_nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as JSON: what the documents lack names the line."""
    li = table(spark, sf_dir, "lineitem")
    parts = F.when(F.col("l_partkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a")))
    line = F.struct(F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.struct(parts.alias("parts")).alias("parcel"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    customer = F.struct(F.col("o_custkey").alias("key"), F.when(F.col("o_custkey") % 2 == 1, "x").otherwise("  ").alias("note"))
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("id"), customer.alias("customer"), F.coalesce("lines", F.array()).alias("lines"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("status")))
    found = nested.conformance(doc, ORDER)
    return orders.select("o_orderkey", found.alias("f")).select("o_orderkey", F.array_join("f.missing", ",").alias("missing"), F.array_join("f.extra", ",").alias("extra"))


PLACES = Plan((Field("place", "object"), Field("name")), transforms=(("website", "NORMALIZE_URL"), ("founded_date", "NORMALIZE_DATE")))


@query("""SELECT s_suppkey AS rec_idx, '{"contacts":[{"email":"s' || s_suppkey || '@example.com"}]' || CASE WHEN s_suppkey % 2 = 0 THEN ',"country":"Germany"' ELSE ',"country":null' END || ',"founded_date":"2020-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') ||
'","sites":{"phone":"+4930' || (1000000 + s_suppkey) || '","website":"https://s' || s_suppkey || '.example.com/"}}' AS place FROM supplier""")
def n15_d9_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects within objects and arrays: each value by its own key, keys sorted on every level."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    contact = F.struct(F.concat(F.lit("  S"), key, F.lit("@Example.com ")).alias("email"))
    sites = F.struct(F.concat(F.lit("s"), key, F.lit(".example.com#top")).alias("website"), F.concat(F.lit("+49 (30) "), (F.col("s_suppkey") + 1_000_000).cast("string")).alias("phone"))
    day = F.concat(F.lit(" 2020-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"))
    place = F.struct(sites.alias("sites"), F.when(F.col("s_suppkey") % 2 == 0, "de").otherwise(" n/a").alias("country"), day.alias("founded_date"), F.array(contact, F.lit(None)).alias("contacts"))
    rows = s.select(F.col("s_suppkey").alias("rec_idx"), F.array(F.lit("https://example.com/")).alias("source_urls"), place.alias("place"), F.col("s_name").alias("name"))
    made = clean.normalize(rows, PLACES).select("rec_idx", "values.place")
    held = F.map_entries("place")
    whole = F.concat(F.lit("{"), F.array_join(F.transform(held, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(e["value"].isNull(), "null").when(e["value"].rlike(r"^[\[{]"), e["value"]).otherwise(F.concat(F.lit('"'), e["value"], F.lit('"'))))), ","), F.lit("}"))
    return made.select("rec_idx", match.stable_json(F.parse_json(whole).cast("map<string,variant>"), "map<string,variant>").alias("place"))
