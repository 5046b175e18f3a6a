"""Operations of a SQL engine that come with the platform, offered on the tables: ranges, frames, grouping sets and windows of time."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.streaming import events as stream


def range_join(left: DataFrame, right: DataFrame, key: str, at: str, width_s: int) -> DataFrame:
    """Pairs of one key whose times are at most ``width_s`` seconds apart: an equi-join on key and time bucket, tested exactly.

    A row lies in one bucket on the left and is sent to three on the right.
    """
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    bucket = F.floor(seconds / width_s)
    a = left.withColumns({"_s": seconds, "_b": bucket})
    b = right.withColumns({"_s2": seconds, "_b": F.explode(F.sequence(bucket - 1, bucket + 1))}).withColumnRenamed(key, "_k2")
    pairs = a.join(b, (a[key] == b["_k2"]) & (a["_b"] == b["_b"]))
    return pairs.where(F.abs(F.col("_s") - F.col("_s2")) <= width_s)


@query("""SELECT a.event_id AS e1, b.event_id AS e2 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= 3600000""")
def z1_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pairs = range_join(e.select(F.col("event_id").alias("e1"), "user_id", "ts"), e.select(F.col("event_id").alias("e2"), "user_id", "ts"), "user_id", "ts", 3600)
    return pairs.where("e1 < e2").select("e1", "e2")


@query("""SELECT p.event_id, max_by(v.event_id, v.ts) AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def z2_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last view at or before each purchase of a user: one window over both, no join."""
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')")
    w = W.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase' AND view_id IS NOT NULL").select("event_id", "view_id")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS g, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def z3_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def z3_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    # balances are summed by nation first; the rollup then works on a row a nation
    by = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"), F.sum("c_acctbal").alias("b"))
    return by.join(n, by.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.sum("k").alias("n"), F.round(F.sum("b"), 2).alias("balance"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS so_far, lag(o_orderkey) OVER w AS previous, ntile(4) OVER w AS quarter, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def z4_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = W.partitionBy("o_custkey").orderBy(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).rangeBetween(-90 * 86_400, 0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("so_far"), F.lag("o_orderkey").over(w).alias("previous"), F.ntile(4).over(w).cast("long").alias("quarter"), F.count(F.lit(1)).over(days).alias("recent"),
    )


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def z5_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.windowed(table(spark, sf_dir, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2""")
def z5_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def z6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events"), "1 day").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query()
def z7_approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


#: Logarithm of a sketch's registers, and the relative standard error that goes with it.
REGISTERS = 12
ERROR = 1.04 / 2 ** (REGISTERS / 2)


@query("""WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day, user_id FROM events), r AS (SELECT DISTINCT day, n FROM d, (VALUES (1), (7), (30)) v(n))
SELECT CAST(r.day AS TIMESTAMP) AS day, CAST(n AS INT) AS days, (SELECT count(DISTINCT user_id) FROM d WHERE d.day <= r.day AND d.day > r.day - n * INTERVAL 1 DAY) AS exact, true AS close FROM r""")
def z7_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of the last 1, 7 and 30 days: sketches are made once a day and united over each range, and told to lie within three standard errors of the exact count."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day"), "user_id")
    daily = e.groupBy("day").agg(F.hll_sketch_agg("user_id", REGISTERS).alias("sketch"))
    days = e.select("day", "user_id").distinct()
    ends = lambda n, k: F.struct(F.lit(n).alias("days"), F.dateadd(F.col("day"), k).cast(e.schema["day"].dataType).alias("end"))
    reach = F.explode(F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), F.lit(n - 1)), partial(ends, n)) for n in (1, 7, 30)]))).alias("r")
    known = daily.select(F.col("day").alias("end"))
    united = daily.select("sketch", reach).select("r.end", "r.days", "sketch").join(known, "end", "left_semi").groupBy("end", "days").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = days.select("user_id", reach).select("r.end", "r.days", "user_id").join(known, "end", "left_semi").groupBy("end", "days").agg(F.count_distinct("user_id").alias("exact"))
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 3 * ERROR * F.col("exact"))
    return united.join(exact, ["end", "days"]).select(F.col("end").alias("day"), "days", "exact", close.alias("close"))
