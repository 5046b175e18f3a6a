"""Event log, runs and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.operators import runs
from siftwork.sources import tables
from siftwork.streaming import events as stream


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND event_id > (SELECT min(event_id) FROM events WHERE event_type = 'view')")
def t1_t2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first = e.where("event_type = 'view'").agg(F.min("event_id")).first()[0]
    return tables.replay(e, "view", first, "event_type", "event_id").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events")
def t3_merged_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return stream.merged([e, e.where("event_type <> 'click'")]).select("event_id", "event_type")


@query("""SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) t USING (user_id) WHERE last IS NULL OR event_id <= last""")
def t4_until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "RUN_FAILED").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), F.col("event_id").alias("seq"), action.alias("action"))
    return stream.until_terminal(e).select("event_id")


@query("""SELECT user_id AS run, count(*) AS events, max(value) AS highest, arg_max(event_type, event_id) AS last_type, count(*) FILTER (WHERE event_type = 'error') AS errors, max(ts) AS last_at FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events) GROUP BY user_id""".replace("arg_max(event_type, event_id)", "arg_max(event_type, o)"))
def t5_live_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.fold(table(spark, sf_dir, "events").withColumnRenamed("user_id", "run"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def t6_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.numbered(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "seq")


@query("""SELECT user_id AS run, event_id AS id, CASE event_id % 5 WHEN 0 THEN 'agent.tool.started' WHEN 1 THEN 'agent.tool.completed' WHEN 2 THEN 'agent.failed' WHEN 3 THEN 'agent.completed' ELSE 'agent.progress' END AS type,
CASE event_id % 5 WHEN 0 THEN CASE WHEN event_type = 'view' THEN 'search' WHEN event_type = 'click' THEN 'scrape' ELSE event_type END WHEN 1 THEN 'search' END AS tool, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_type = 'view' THEN 'SEARCH' WHEN event_type = 'click' THEN 'SCRAPE' END WHEN 1 THEN 'SEARCH' END AS step,
CASE event_id % 5 WHEN 0 THEN CASE WHEN event_type = 'view' THEN 'Searching the web for user ' || user_id WHEN event_type = 'click' THEN 'Scraping u' || user_id || '.example.com' ELSE event_type || ' started' END WHEN 1 THEN 'Search returned 2 results'
WHEN 2 THEN 'key [REDACTED] of ' || event_type WHEN 3 THEN 'Agent completed in ' || user_id || ' ms' ELSE 'Agent emitted text progress' END AS summary,
CASE event_id % 5 WHEN 3 THEN '{"durationMs":' || user_id || ',"model":"unknown"}' WHEN 4 THEN '{"characterCount":' || length(event_type) || '}' END AS details, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events""")
def t6_tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, results, failures, ends and texts of an agent as numbered events of its run, with type, step and summary."""
    return stream.sequenced(stream.tool_events(agent_chunks(table(spark, sf_dir, "events"))))


def agent_chunks(e: DataFrame) -> DataFrame:
    """Tool calls and results made of the events' own columns."""
    k, user, t = F.col("event_id") % 5, F.col("user_id").cast("string"), F.col("event_type")
    tool = F.when(k == 1, "search").when(k == 0, F.when(t == "view", "search").when(t == "click", "scrape").otherwise(t))
    call = F.concat(F.lit('{"query":"user '), user, F.lit('","url":"https://U'), user, F.lit('.example.com/x"}'))
    found = F.concat(F.lit('{"data":{"web":[{"url":"https://a.example.com/"},{"title":"'), t, F.lit('"},{"n":1}]}}'))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("tool-call", "tool-result", "error", "done", "text")]), (k + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("id"), kinds.alias("kind"), tool.alias("tool"), F.when(k == 0, call).when(k == 1, found).alias("body"), F.when(k == 2, F.concat(F.lit("key fc-abcdefghijkl0123 of "), t)).alias("error"),
        F.when(k == 4, t).alias("content"), F.when(k == 3, F.col("user_id")).alias("duration_ms"), F.lit(None).cast("string").alias("model"),
    )


_STEPS = """s AS (SELECT l_orderkey AS run, l_linenumber AS step, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END AS status, CAST(l_quantity AS BIGINT) AS records FROM lineitem)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED")
    before = F.when(F.col("l_linenumber") > 1, F.array(F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), before.alias("depends_on"), status.alias("status"), F.col("l_quantity").cast("long").alias("records"))


@query(f"WITH {_STEPS} SELECT a.run, a.step, a.step = 1 OR EXISTS (SELECT 1 FROM s b WHERE b.run = a.run AND b.step = a.step - 1 AND b.status = 'COMPLETED') AS runnable FROM s a")
def r1_dependency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gate(_steps(spark, sf_dir)).select("run", "step", "runnable")


@query(f"""WITH {_STEPS}, g AS (SELECT run, count(*) AS steps, count(*) FILTER (WHERE status = 'COMPLETED') AS done, CASE WHEN bool_or(status = 'FAILED') THEN CASE WHEN sum(records) > 0 THEN 'PARTIAL' ELSE 'FAILED' END ELSE 'COMPLETED' END AS status FROM s GROUP BY run)
SELECT run, status, steps, done, CASE WHEN status = 'COMPLETED' THEN 100 ELSE least(99, CAST(floor(done * 100 / steps) AS BIGINT)) END AS progress FROM g""")
def r2_r3_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_status(_steps(spark, sf_dir)).withColumn("progress", runs.progress(F.col("done"), F.col("steps"), F.col("status")))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def w7_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the top 100: the limit is the feature."""
    return runs.latest(table(spark, sf_dir, "events").select("event_id", "ts"))


_RUNS = """u AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'COMPLETED' ELSE 'RUNNING' END AS status, o_orderkey % 7 = 0 AS cancelled FROM orders)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, status = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("run"), F.when(status == "O", "PENDING").when(status == "F", "COMPLETED").otherwise("RUNNING").alias("status"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("cancelled_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
    )


@query(f"""WITH {_RUNS}, w AS (SELECT l_orderkey AS run, min(l_suppkey) AS worker FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey)
SELECT u.run, CASE WHEN won THEN 'RUNNING' ELSE status END AS status, CAST(won AS INT) AS attempt, CASE WHEN won THEN worker END AS worker FROM (SELECT u.*, worker, status = 'PENDING' AND NOT cancelled AND worker IS NOT NULL AS won FROM u LEFT JOIN w USING (run)) u""")
def r4_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers ask for runs; of several the least gets a run, once."""
    wanted = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("worker"))
    after, claims = runs.claim(_runs(spark, sf_dir), wanted, F.lit("2024-01-31").cast("timestamp_ntz"))
    return after.join(claims, "run", "left").select("run", "status", "attempt", "worker")


@query(f"""WITH {_RUNS}, s AS (SELECT l_orderkey AS run, l_linenumber AS step, CASE WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'COMPLETED' END AS status FROM lineitem), f AS (SELECT run FROM u WHERE run % 3 = 0 AND status <> 'COMPLETED')
SELECT 'run' AS kind, run, CAST(0 AS INT) AS step, CASE WHEN run IN (FROM f) THEN 'FAILED' ELSE status END AS status, CASE WHEN run IN (FROM f) THEN repeat('E', 100) END AS error_code FROM u
UNION ALL SELECT 'step', run, step, CASE WHEN run IN (FROM f) AND status = 'PENDING' THEN 'FAILED' ELSE status END, CASE WHEN run IN (FROM f) AND status = 'PENDING' THEN repeat('E', 100) END FROM s
UNION ALL SELECT 'event', run, 0, 'RUN_FAILED', repeat('E', 100) FROM f""")
def r12_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failure takes an open run and its open steps with it; completed ones stay."""
    li, none = table(spark, sf_dir, "lineitem"), F.lit(None).cast("string")
    steps = li.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.when(F.col("l_linestatus") == "O", "PENDING").otherwise("COMPLETED").alias("status"), none.alias("error_code"), none.alias("error_message"))
    of = _runs(spark, sf_dir)
    failures = of.where("run % 3 = 0").select("run", F.repeat(F.lit("E"), 120).alias("code"), F.lit("lost").alias("message"))
    after, steps, events = runs.fail(of, steps, failures)
    zero = F.lit(0).cast("int").alias("step")
    out = after.select(F.lit("run").alias("kind"), "run", zero, "status", "error_code").unionByName(steps.select(F.lit("step").alias("kind"), "run", "step", "status", "error_code"))
    return out.unionByName(events.select(F.lit("event").alias("kind"), "run", zero, F.col("action").alias("status"), "error_code"))


@query("""SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS title FROM orders""")
def r13_saved_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saving all runs, twice, adds a dataset to those that have none."""
    o = table(spark, sf_dir, "orders")
    datasets = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run"), F.lit("old").alias("title"))
    new = o.select(F.col("o_orderkey").alias("run"), F.lit("new").alias("title"))
    return runs.save_once(runs.save_once(datasets, new), new)


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS may FROM customer")
def r9_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_mktsegment") == "BUILDING", "OWNER").when(F.col("c_mktsegment") == "MACHINERY", "ADMIN").when(F.col("c_mktsegment") == "FURNITURE", "VIEWER").otherwise("guest")
    return table(spark, sf_dir, "customer").select("c_custkey", runs.role_allows(role, "ADMIN").alias("may"))


@query("""SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 10080 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS label
FROM (SELECT event_id, ts, (epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) // 60000 AS m FROM events)""")
def r10_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", runs.relative_label(F.col("ts"), F.to_timestamp(F.lit("2024-01-31"))).alias("label"))


@query("""SELECT user_id AS run, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_in, CAST(0 AS BIGINT) AS tokens_out, count(*) AS tool_calls, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM events x WHERE x.user_id = e.user_id)) AS tools FROM events e GROUP BY user_id""")
def q14_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"))
    return runs.usage(e)


@query("""SELECT conv_id, string_agg('[' || upper(role) || ' ' || turn || ']: ' || substr(coalesce(text, ''), 1, 500), chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.transcript(table(spark, sf_dir, "conversations"), 500)


@query("""SELECT key, min(turn) AS turn FROM (SELECT conv_id AS key, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s >= 1500 GROUP BY key""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.budget_reached(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), "turn", F.length("text").alias("tokens")), 2000)


@query("""SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n, event_id % 2 = 0 AS some FROM events""")
def null_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, "")
    m = runs.strip_empty(F.create_map(F.lit("a"), F.col("props"), F.lit("b"), other))
    return table(spark, sf_dir, "events").select("event_id", F.size(m).alias("n"), runs.has_result(other).alias("some"))


@query("""SELECT event_id AS id, CAST(0 AS INT) AS pos, CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'tool-call' ELSE 'tool-result' END AS type, CASE WHEN event_id % 3 > 0 THEN event_type END AS tool, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN replace(props, ' ', '') ELSE 'user ' || user_id END AS content FROM events
UNION ALL SELECT event_id, 1, 'tool-call', 'again', '{}' FROM events WHERE event_id % 3 = 1""")
def t7_agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an agent's stream to events: texts, tool calls, and tools' results among other messages."""
    k, t = F.col("event_id") % 3, F.col("event_type")
    said = F.concat(F.lit('{"text":"'), t, F.lit('"}'))
    calls = F.concat(F.lit('{"text":"","tool_calls":[{"name":"'), t, F.lit('","args":'), F.replace("props", F.lit(" "), F.lit("")), F.lit('},{"name":"again","args":{}}]}'))
    update = F.concat(F.lit('{"tools":{"messages":[{"type":"ai","content":"x"},{"type":"tool","name":"'), t, F.lit('","content":"user '), F.col("user_id").cast("string"), F.lit('"}]},"idle":{}}'))
    chunks = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(k < 2, "messages").otherwise("updates").alias("mode"), F.when(k == 0, said).when(k == 1, calls).otherwise(update).alias("body"))
    return stream.agent_events(chunks)
