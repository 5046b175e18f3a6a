"""The event log as streams: append, live merge without repetitions, folds, windows and limiter state."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from siftwork.functions import urls
from siftwork.operators.govern import Window, safe_message
from siftwork.sources import payloads

#: Actions after which a run sends nothing more.
TERMINAL = ("RUN_COMPLETED", "RUN_FAILED", "RUN_CANCELLED")


def read(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A directory of event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Durable append: each event lands once, also over restarts."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merged(feeds: list[DataFrame], key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Several feeds as one without repeated ids; a watermark bounds what is remembered."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    if out.isStreaming:
        return out.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return out.dropDuplicates([key])


def until_terminal(events: DataFrame, run: str = "run", seq: str = "seq", action: str = "action") -> DataFrame:
    """Events up to each run's first terminal one (a batch; the end is an aggregate, not a window)."""
    ends = events.where(F.col(action).isin(*TERMINAL)).groupBy(run).agg(F.min(seq).alias("_end"))
    return events.join(ends, run, "left").where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).drop("_end")


def fold(events: DataFrame, key: str = "run") -> DataFrame:
    """Live state of runs: last event, highest counters, number of events by kind."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"), F.max("value").alias("highest"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last_at"),
    )


def numbered(events: DataFrame, run: str, *order: str) -> DataFrame:
    """A sequence number from 1 within each run (a batch)."""
    from pyspark.sql import Window as W

    return events.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy(*order)).cast("long"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts and sums of ``value`` by time window and kind."""
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return source.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str = "user_id", late: str | None = None) -> DataFrame:
    """Sessions that end after a gap without events."""
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    return source.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


class Limiter(StatefulProcessor):
    """Sliding-window limit with the accepted times of each key as state. Calls are judged when they arrive, in the order of their times within a batch.

    A key that has had no call for ``idle_ms`` of processing time leaves the state store.
    """

    def __init__(self, limit: int, width_ms: int, interval_ms: int, idle_ms: int):
        self.limit, self.width_ms, self.interval_ms, self.idle_ms = limit, width_ms, interval_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        window = Window(self.limit, self.width_ms, self.interval_ms, [t[0] for t in self.times.get()] if self.times.exists() else [])
        calls = pd.concat(list(rows)).sort_values(["at", "id"])
        out = [(key[0], int(i), int(at), *window.ask(int(at))) for i, at in zip(calls["id"], calls["at"])]
        self.times.put([(t,) for t in window.times])
        yield pd.DataFrame(out, columns=["key", "id", "at", "allowed", "retry_after_ms"])

    def close(self) -> None:
        pass


def limited(calls: DataFrame, limit: int, width_ms: int = 60_000, interval_ms: int = 0, idle_ms: int | None = None) -> DataFrame:
    """A stream of calls (key, id, at in ms) with the limiter's decisions. Needs the RocksDB state store.

    As state expires by the clock, Spark goes on with batches without data: a run that should end when all
    is read needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.

    Without ``idle_ms`` a key is forgotten after twice the window or interval, a minute at least; a
    stream that replays old calls more slowly than they came needs a longer time.
    """
    schema = "key string, id long, at long, allowed boolean, retry_after_ms long"
    idle_ms = idle_ms or max(60_000, 2 * width_ms, 2 * interval_ms)
    return calls.groupBy("key").transformWithStateInPandas(Limiter(limit, width_ms, interval_ms, idle_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


class Counter(StatefulProcessor):
    """Numbers the rows of each run from 1 on, in the order of ``at`` within a batch; the last number is state, so a restarted stream goes on."""

    def __init__(self, order: list[str], names: list[str]):
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key, rows, timerValues):
        held = pd.concat(list(rows)).sort_values(self.order)
        last = self.last.get()[0] if self.last.exists() else 0
        held["seq"] = range(last + 1, last + 1 + len(held))
        self.last.update((last + len(held),))
        yield held[[*self.names, "seq"]]

    def close(self) -> None:
        pass


#: The kind of step that a tool belongs to.
STEP_OF_TOOL = {"search": "SEARCH", "scrape": "SCRAPE", "interact": "INTERACT", "formatOutput": "EXTRACT", "bashExec": "TRANSFORM"}


def tool_events(chunks: DataFrame) -> DataFrame:
    """``chunks`` (run, id, kind, tool, body: JSON of a call's input or a result's output, error, content, duration_ms, model) as run events: run, id, type, tool, step, summary, details.

    Row-local, so it runs on a batch and on a stream; ``sequenced`` numbers either. Summaries are
    fixed values. Domains come from the body's url; errors are free of known keys.
    """
    kind, tool, error = F.col("kind"), F.coalesce("tool", F.lit("unknown")), safe_message(F.col("error"))
    at = lambda path: F.get_json_object("body", path)
    domain, text = urls.host(at("$.url")), F.concat
    query = text(F.lit(" for "), F.substring(at("$.query"), 1, 180))
    started = (
        F.when(tool == "search", text(F.lit("Searching the web"), F.coalesce(query, F.lit(""))))
        .when((tool == "scrape") & domain.isNotNull(), text(F.lit("Scraping "), domain))
        .when((tool == "interact") & domain.isNotNull(), text(F.lit("Interacting with "), domain))
        .when(tool == "formatOutput", "Formatting structured extraction output")
        .otherwise(text(tool, F.lit(" started")))
    )
    failed = safe_message(at("$.error"))
    pages = text(tool, F.lit(" returned content for "), F.coalesce(urls.host(F.coalesce(at("$.url"), at("$.data.url"))), F.lit("a source")))
    completed = (
        F.when((tool == "search") & failed.isNotNull(), text(F.lit("Search failed: "), failed))
        .when(tool == "search", text(F.lit("Search returned "), F.size(payloads.hits(F.col("body"))).cast("string"), F.lit(" results")))
        .when(tool.isin("scrape", "interact", "map") & failed.isNotNull(), text(tool, F.lit(" failed: "), failed))
        .when(tool.isin("scrape", "interact", "map"), pages)
        .otherwise(text(tool, F.lit(" completed")))
    )
    duration = F.coalesce("duration_ms", F.lit(0)).cast("string")
    summary = (
        F.when(kind == "tool-call", started).when(kind == "tool-result", completed).when(kind == "error", F.coalesce(error, F.lit("Agent execution failed")))
        .when(kind == "done", text(F.lit("Agent completed in "), duration, F.lit(" ms"))).otherwise(text(F.lit("Agent emitted "), kind, F.lit(" progress")))
    )
    types = F.when(kind == "tool-call", "agent.tool.started").when(kind == "tool-result", "agent.tool.completed").when(kind == "error", "agent.failed").when(kind == "done", "agent.completed").otherwise("agent.progress")
    on_tool = kind.isin("tool-call", "tool-result")
    step = reduce(lambda c, t: c.when(tool == t[0], t[1]), list(STEP_OF_TOOL.items())[1:], F.when(tool == "search", "SEARCH"))
    details = (
        F.when(kind == "done", F.to_json(F.struct(F.coalesce("duration_ms", F.lit(0)).cast("long").alias("durationMs"), F.coalesce("model", F.lit("unknown")).alias("model"))))
        .when((kind == "text") & (F.length("content") > 0), F.to_json(F.struct(F.length("content").alias("characterCount"))))
    )
    return chunks.select("run", "id", types.alias("type"), F.when(on_tool, tool).alias("tool"), F.when(on_tool, step).alias("step"), summary.alias("summary"), details.alias("details"))


def sequenced(events: DataFrame, order: str = "id") -> DataFrame:
    """Events with ``seq`` from 1 on in each run. On a stream the numbers go on where the last batch ended, also after a restart (RocksDB state store); on a batch they come from a window."""
    if not events.isStreaming:
        return numbered(events, "run", order)
    schema = T.StructType([*events.schema.fields, T.StructField("seq", T.LongType())])
    return events.groupBy("run").transformWithStateInPandas(Counter([order], events.columns), outputStructType=schema, outputMode="Append", timeMode="None")


_SAID = "struct<text:string,tool_calls:array<struct<name:string,args:string>>>"
_MESSAGES = "array<struct<type:string,name:string,content:string>>"
_UPDATES = f"map<string,struct<messages:{_MESSAGES}>>"
_EVENT = "array<struct<type:string,tool:string,content:string>>"


def agent_events(chunks: DataFrame) -> DataFrame:
    """id, pos, type, tool and content of the events in an agent's stream: ``chunks`` (id, mode, body as JSON).

    A chunk of mode messages holds a text, if it isn't empty, and tool calls; one of mode updates
    holds, by node, messages, of which the tools' are results. Row-local, so it also runs on a stream.
    """
    event = lambda kind, tool, content: F.struct(F.lit(kind).alias("type"), tool.cast("string").alias("tool"), content.alias("content"))
    said, updates = F.from_json("body", _SAID), F.from_json("body", _UPDATES)
    text = F.when(F.length(said["text"]) > 0, F.array(event("text", F.lit(None), said["text"]))).cast(_EVENT)
    calls = F.transform(said["tool_calls"], lambda c: event("tool-call", c["name"], c["args"])).cast(_EVENT)
    no_messages = F.array().cast(_MESSAGES)
    tools = lambda n: F.filter(F.coalesce(n["messages"], no_messages), lambda m: m["type"] == "tool")
    results = F.transform(F.map_values(updates), lambda n: F.transform(tools(n), lambda m: event("tool-result", m["name"], m["content"])))
    results = F.flatten(results).cast(_EVENT)
    none = F.array().cast(_EVENT)
    found = F.when(F.col("mode") == "messages", F.concat(F.coalesce(text, none), F.coalesce(calls, none))).when(F.col("mode") == "updates", F.coalesce(results, none)).otherwise(none)
    return chunks.select("id", F.posexplode(found).alias("pos", "e")).select("id", "pos", "e.type", "e.tool", "e.content")
