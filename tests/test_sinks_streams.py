"""Files read back, and streams run to their end."""

import csv
import hashlib
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwork.operators import govern
from siftwork.sources import sinks, tables
from siftwork.streaming import events as stream

ROWS = [(1, 'quote " comma, ', 1.5, ["a"]), (2, "line\nbreak", None, []), (3, None, float("inf"), None), (4, "é", 2.0, ["b", "c"])]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "id long, text string, n double, tags array<string>").orderBy("id")


def test_csv(df, tmp_path):
    done = sinks.write_csv(df, str(tmp_path / "o.csv"), {"id": "The, id"})
    raw = (tmp_path / "o.csv").read_bytes()
    assert done.rows == 4 and done.size == len(raw) and done.sha256 == hashlib.sha256(raw).hexdigest() and raw.endswith(b"\r\n")
    back = list(csv.reader(io.StringIO(raw.decode(), newline="")))
    assert back[0] == ["The, id", "text", "n", "tags"] and back[1] == ["1", 'quote " comma, ', "1.5", '["a"]'] and back[3] == ["3", "", "", ""]


def test_json(df, tmp_path):
    done = sinks.write_json(df, str(tmp_path / "o.json"))
    back = json.loads((tmp_path / "o.json").read_text())
    assert done.rows == 4 and back[1]["n"] is None and back[3] == {"id": 4, "text": "é", "n": 2.0, "tags": ["b", "c"]}
    assert (tmp_path / "o.json").read_text().startswith("[\n  {")


def test_xlsx(df, tmp_path):
    done = sinks.write_xlsx(df, str(tmp_path / "o.xlsx"), {"text": "A label that is rather long for a column of a sheet"})
    with zipfile.ZipFile(tmp_path / "o.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert 'name="Dataset"' in z.read("xl/workbook.xml").decode()
    assert done.rows == 4 and sheet.count("<row ") == 5 and '<c r="C2"><v>1.5</v></c>' in sheet and 'width="40"' in sheet and 'width="14"' in sheet
    assert "quote &quot;" in sheet or 'quote " comma' in sheet
    assert re.search(r'<c r="D5" t="inlineStr"><is><t xml:space="preserve">\["b","c"\]</t>', sheet)


def test_export_job(df, tmp_path):
    ok = sinks.export(df, str(tmp_path), "My Data!", "0123456789", "csv")
    assert ok["status"] == "COMPLETED" and ok["path"].endswith("my-data-01234567.csv") and ok["rows"] == 4
    bad = sinks.export(df.select(F.raise_error(F.lit("boom")).alias("x")), str(tmp_path), "Bad", "99999999", "csv")
    assert bad["status"] == "FAILED" and bad["error"] and not list(tmp_path.glob("bad-*"))
    with pytest.raises(PermissionError):
        sinks.contained(str(tmp_path), "../x")


def test_empty_export(df, tmp_path):
    assert sinks.write_json(df.limit(0), str(tmp_path / "e.json")).rows == 0
    assert json.loads((tmp_path / "e.json").read_text()) == []


def test_readers(spark, df, tmp_path):
    sinks.bulk(df.select("id", "text"), str(tmp_path / "csv"))
    back = tables.table(spark, str(tmp_path / "csv"), kind="csv", schema="id long, text string", header=True, multiLine=True, escape='"')
    assert back.count() == 4
    sinks.bulk(df, str(tmp_path / "orc"), "orc")
    assert tables.table(spark, str(tmp_path / "orc"), ["id"], "orc").count() == 4
    with pytest.raises(ValueError):
        tables.table(spark, "x", kind="xml")


def test_replay(spark):
    e = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(10)], "seq long, entity_id string")
    assert [r.seq for r in tables.replay(e, "a", 3).collect()] == [5, 7, 9]
    assert tables.replay(e, "a", 4).collect() == [] and tables.replay(e, "a").count() == 5


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def feed(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path = str(tmp_path / "feed")
    e.repartition(3).write.parquet(path)
    return path, e


def test_append_and_merge(spark, feed, tmp_path):
    path, e = feed
    source = stream.merged([stream.read(spark, path, SCHEMA), stream.read(spark, path, SCHEMA)], late="60 days")
    query = stream.append(source, str(tmp_path / "log"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == e.count()
    # a second run has nothing to add
    stream.append(stream.merged([stream.read(spark, path, SCHEMA), stream.read(spark, path, SCHEMA)], late="60 days"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == e.count()


def collected(spark, df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name)


def test_streaming_windows_equal_batch(spark, feed, tmp_path):
    path, e = feed
    got = collected(spark, stream.windowed(stream.read(spark, path, SCHEMA), "1 day"), "w", tmp_path, "complete")
    want = stream.windowed(e, "1 day")
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_streaming_fold_equals_batch(spark, feed, tmp_path):
    path, e = feed
    got = collected(spark, stream.fold(stream.read(spark, path, SCHEMA), "user_id"), "f", tmp_path, "complete")
    assert sorted(got.collect()) == sorted(stream.fold(e, "user_id").collect())


def test_streaming_limiter(spark, feed, tmp_path):
    path, e = feed
    calls = lambda df: df.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.unix_millis("ts").alias("at"))
    one = str(tmp_path / "one")
    e.coalesce(1).write.parquet(one)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    got = collected(spark, stream.limited(calls(stream.read(spark, one, SCHEMA)), 3, 3_600_000), "l", tmp_path, "append")
    want = govern.limit_calls(calls(e), 3, 3_600_000).select("key", "id", "at", "allowed", "retry_after_ms")
    assert sorted(got.collect()) == sorted(want.collect())
