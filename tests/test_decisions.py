"""Decisions that depend on those before them, against loops in order; rules, verified values and sketches of state."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwork import catalog
from siftwork.functions import urls, values
from siftwork.operators import govern, graph, match, provenance
from siftwork.operators.store import settled
from siftwork.streaming import events as stream


def in_order(rows):
    known, held = {}, {}
    for rec, rule, k in rows:
        held.setdefault(rec, []).append((rule, k))
    for rec in sorted(held):
        if not any(x in known for x in held[rec]):
            known |= {x: rec for x in held[rec]}
    return known


@pytest.mark.parametrize("most", [1_000_000, 25])
def test_registration(spark, monkeypatch, most):
    monkeypatch.setattr(match, "IN_ORDER", most)
    rng = random.Random(1)
    rows = list({(r, rule, b"%d" % rng.randint(0, 30)) for r in range(60) for rule in range(2)}) + [(1000 + i, 5, b"c%d" % j) for i in range(18) for j in (i, i + 1)]
    table = settled(spark.createDataFrame([(r, rule, bytearray(k)) for r, rule, k in rows], "rec_idx long, rule int, k binary"))
    assert {(x.rule, bytes(x.k)): x["first"] for x in match.registered(table).collect()} == in_order(rows)
    assert match.registered(settled(table.limit(0))).count() == 0


def test_long_chain(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("rec_idx"), F.lit(0).alias("rule"), F.explode(F.array("id", F.col("id") + 1)).alias("x")).select("rec_idx", "rule", F.unhex(F.md5(F.col("x").cast("string"))).alias("k"))
    found = match.registered(settled(chain))
    assert found.count() == n and found.agg(F.min(F.col("first") % 2), F.max(F.col("first") % 2)).first()[:] == (0, 0)


def test_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(900, 950).select("id", F.lit(900).cast("long")))
    got = {r.idx: r.root for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {k: 900 for k in range(901, 950)}


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1.0 if a == b else 1 - row[-1] / max(len(a), len(b))


@pytest.mark.parametrize("blocking", [[0], []])
def test_best_earlier(spark, blocking):
    rng = random.Random(len(blocking))
    names = ["acmeindustries", "acmeindustriez", "globexcorporation", "xglobexcorporatio", "globexcorporatiom", "acmeindustrie", "zzcmeindustries"]
    rows = sorted((i, rng.choice(names), [rng.choice([None, "a", "b", "c"]), rng.choice([None, None, "x", "y"])]) for i in rng.sample(range(500), 60))
    gone, want = set(), {}
    for i, name, ids in rows:
        found = []
        for j, other, jds in rows:
            shared = any(a is not None and a == b for a, b in zip(ids, jds))
            if j < i and j not in gone and similarity(name, other) >= 0.85 - 1e-12 and (name[:2] == other[:2] or any(ids[b] is not None and ids[b] == jds[b] for b in blocking)):
                found.append((not shared, -similarity(name, other), j))
        if found:
            other, distance, j = min(found)
            want[i] = (j, not other, round(-distance, 6))
            gone |= set() if other else {i}
    table = settled(spark.createDataFrame(rows, "rec_idx long, name string, ids array<string>"))
    assert {r.duplicate_idx: (r.canonical_idx, r.shared, round(r.confidence, 6)) for r in match.best_earlier(table, 0.85, blocking).collect()} == want


def test_equal_names_in_linear_space(spark):
    many = spark.range(100_000).select(F.col("id").alias("rec_idx"), F.lit("samename").alias("name"), F.array(F.when(F.col("id") % 3 == 0, (F.col("id") % 1000).cast("string"))).alias("ids"))
    got = {r.shared: r["count"] for r in match.best_earlier(settled(many), 0.85, []).groupBy("shared").count().collect()}
    assert got == {True: 33_334 - 1_000, False: 99_999 - (33_334 - 1_000)}


@pytest.mark.parametrize("segment, rounds", [(50, 8), (50, 0)])
def test_limiter_in_segments(spark, monkeypatch, segment, rounds):
    monkeypatch.setattr(govern, "SEGMENT", segment)
    monkeypatch.setattr(govern, "ROUNDS", rounds)
    rng, rows, at = random.Random(6), [], 0
    for i in range(500):
        at += rng.randint(0, 9) + 1000 * (i == 300)
        rows.append((rng.choice([1, 1, 1, 2, None]), i, at))
    windows, want = {}, set()
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        w = windows.setdefault(k, govern.Window(3, 100, 20))
        ok, wait = w.ask(t)
        want.add((k, i, t, ok, wait, max(0, 3 - len(w.times))))
    got = [tuple(r) for r in govern.limit_calls(spark.createDataFrame(rows, "key long, id long, at long").repartition(3), 3, 100, 20).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_robots_rules(spark):
    rng = random.Random(7)
    paths = ["/" + "".join(rng.choice("ab/.*?$") for _ in range(rng.randint(0, 5))) + rng.choice(["", "", "*", "$"]) for _ in range(60)]
    rules = [(f"https://o{rng.randint(0, 2)}.example.com", rng.random() < 0.5, p, rng.choice([None, 1000, 2000])) for p in paths]
    asked = [(rng.randint(0, 40), f"https://o{rng.randint(0, 3)}.example.com/" + "".join(rng.choice("ab/.?") for _ in range(rng.randint(0, 8)))) for _ in range(200)] + [(1, None)]
    want = Counter()
    for i, url in asked:
        origin, target = (None, None) if url is None else (url[:22], url[22:])
        hits = []
        for o, allow, p, _ in rules:
            pattern = "^" + ".*".join(map(re.escape, p.removesuffix("$").split("*"))) + "$" * p.endswith("$")
            if o == origin and re.search(pattern, urlform(target)):
                hits.append((len(re.sub(r"[*$]", "", p)), allow))
        want[i, url, not hits or max(hits)[1], max((d for o, *_, d in rules if o == origin and d), default=None)] += 1
    table = spark.createDataFrame([(i, u, "x") for i, u in asked], "id long, url string, _rule string")
    got = govern.robots_decisions(table, spark.createDataFrame(rules, "origin string, allow boolean, path string, delay_ms long"))
    assert got.columns[:3] == ["id", "url", "_rule"]
    assert Counter((r.id, r.url, r.allowed, r.delay_ms) for r in got.collect()) == want


def urlform(target):
    """A target as URL parsers leave it: without dot segments and empty queries."""
    path, mark, query = target.partition("?")
    out, parts = [], path.split("/")[1:]
    for k, s in enumerate(parts):
        if s == "..":
            out = out[:-1]
        elif s != ".":
            out.append(s)
            continue
        if k == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out) + (mark + query if query else "")


def test_verified_pairs(spark):
    rng = random.Random(8)
    words = ["solar", "wind", "an", "é", "Ünd", "x", "energy's", "12", "a b"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    snippets = [(k, rng.choice([said(8), said(3) + "\n" + said(2)])) for k in range(60)] + [(100, None), (101, " ")]
    asked = [(k, said(3)) for k in range(60)] + [(100, None), (101, " "), (102, "x"), (103, "  SOLAR  ")]
    want = set()
    for i, s in snippets:
        for j, v in asked:
            if (s or "").strip() and v is not None:
                low, value = s.lower(), v.strip(" ").lower()
                parts = [w for w in re.split(r"\s+", value) if len(w) >= 3]
                if (len(value) >= 2 and value in low) or (parts and all(w in low for w in parts)):
                    want.add((i, j))
    got = provenance.verified_pairs(spark.createDataFrame(snippets, "sid long, snippet string"), spark.createDataFrame(asked, "vid long, value string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    held = spark.createDataFrame([("Ann at Acme", {"a": "acme", "b": None}), ("none", {"a": "acme"}), ("x", None)], "s string, v map<string,string>")
    assert [r[0] for r in held.select(provenance.verifies_object(F.col("s"), F.col("v"))).collect()] == [True, False, False]


@pytest.mark.parametrize("direct", [0, 1, 32])
def test_verified_pairs_beyond_what_is_sent(spark, monkeypatch, direct):
    """A small file may hold many rows: what is sent whole to the tasks is bounded by rows and texts, and the shuffled and the direct way find the same."""
    plans, settled = [], provenance.settled
    monkeypatch.setattr(provenance, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settled(df))
    monkeypatch.setattr(provenance, "BROADCAST", -1)
    monkeypatch.setattr(provenance, "DIRECT", direct, raising=False)
    snippets = spark.range(200).selectExpr("id as sid", "concat('Nation ', id % 9, ' banana', id, ' of the  whole\tarrangement ', if(id % 3 = 0, 'e g', 'part')) as snippet")
    values = spark.createDataFrame(enumerate(["na", "NA", "ban", "part", "e g", "the whole", "the  whole", "banana17", "of banana", "missing na", "\t", " ", "x", None, "  "]), "vid long, value string")
    got = provenance.verified_pairs(snippets, values)
    want = snippets.crossJoin(values).where(provenance.verifies(F.col("snippet"), F.col("value"))).select("sid", "vid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]


def test_every_customer_is_looked_for(spark, tmp_path):
    """The query reads its tables whole, as its SQL does: no customer is left out by its key."""
    import duckdb

    catalog.load()
    rows = {
        "benchmark": ("item_id long, text string", [(1, "a building of brick")]),
        "customer": ("c_custkey long, c_mktsegment string", [(k, ("BUILDING", "MACHINERY")[k % 2]) for k in range(1, 25)]),
        "nation": ("n_nationkey long, n_name string", [(1, "BRAZIL")]),
        "documents": ("doc_id long, text string", [(1, "The building 12"), (2, "a building of brick"), (3, "brick"), (4, " "), (5, None)]),
    }
    con = duckdb.connect()
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, catalog.QUERIES["e1_snippets"](spark, str(tmp_path)).collect()))
    assert got == sorted((d, -1 - k) for d in (1, 2) for k in range(2, 25, 2)) + [(2, 1), (2, 1_000_001), (3, 1_000_001)]
    assert got == sorted(con.execute(catalog.SQL["e1_snippets"]).fetchall())


def test_hosts_beyond_ascii(spark):
    # samples of the bootstring standard
    assert urls.ascii_label("bücher") == "xn--bcher-kva" and urls.ascii_label("他们为什么不说中文") == "xn--ihqwcrb4cv8a8dqg056pqjye" and urls.ascii_label("Pročprostěnemluvíčesky") == "xn--proprostnemluvesky-uyb24dma41a"
    cases = {"https://BÜCHER.example/ü?q=é#x": "https://xn--bcher-kva.example/ü?q=é#x", "http://me@faß。de:80/": "http://me@xn--fa-hia.de:80/", "https://plain.example/é": "https://plain.example/é", "ftp://ｅx.example": "ftp://ex.example", "no url é": "no url é"}
    table = spark.createDataFrame([(c,) for c in cases] + [(None,)], "u string")
    assert {r.u: r.a for r in table.select("u", urls.with_ascii_host(F.col("u")).alias("a")).collect()} == cases | {None: None}


def test_numbers_and_regions(spark):
    table = spark.createDataFrame([("9" * 400, "UK"), ("1e", "curaçao"), ("5k", "zz"), ("-1.5", None)], "n string, c string")
    assert [tuple(r) for r in table.select(values.number(F.col("n")), values.country(F.col("c"))).collect()] == [(None, "United Kingdom"), (1.0, "Curaçao"), (5000.0, "zz"), (-1.5, None)]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(source, path, name):
    q = source.writeStream.format("parquet").option("path", str(path / name)).option("checkpointLocation", str(path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)


@pytest.mark.parametrize("idle_ms", [1_500, 3_600_000])
def test_idle_keys_leave_the_state(spark, tmp_path, idle_ms):
    """A restarted stream goes on with the logs of keys that weren't idle for too long; the others are gone from the store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def send(key, ids):
        spark.createDataFrame([(key, i, i) for i in ids], "key string, id long, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(stream.limited(spark.readStream.schema("key string, id long, at long").parquet(str(tmp_path / "in")), 2, 1000, idle_ms=idle_ms), tmp_path, "out")
        return {r.key.key for r in spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "out-cp")).collect()}

    assert send("a", range(3)) == {"a"}
    time.sleep(3)
    kept = idle_ms > 3_000
    assert send("b", [10]) == ({"a", "b"} if kept else {"b"})
    send("a", [20])
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).where("allowed").collect()} == ({0, 1, 10} if kept else {0, 1, 10, 20})


def test_numbers_go_on_over_restarts(spark, data, tmp_path):
    from siftwork.catalog.events import agent_chunks

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    e = spark.read.parquet(f"{data}/events.parquet").where("event_id < 600")
    schema = agent_chunks(e).schema
    for low in (0, 300):
        agent_chunks(e.where(f"event_id >= {low} AND event_id < {low + 300}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(stream.sequenced(stream.tool_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))), tmp_path, "out")
    want = stream.sequenced(stream.tool_events(agent_chunks(e)))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_url_plans_stay_small(spark, data):
    from siftwork import catalog

    catalog.load()
    for name in ("pages_by_host", "g5_p14_decisions"):  # parts are made once: 302,000 characters before
        text = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert len(text) < 75_000
