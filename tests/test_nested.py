"""Nested documents against recursive loops."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from siftwork.operators import nested, rank
from siftwork.plans.model import Plan, SourcePolicy

WORDS = ["solar", "wind", "energy", "the", "cats", "power"]
TERMS, BLOCKED = ["solar", "wind", "energy"], {"c.net"}


def said(x):
    """(url, title, snippet) of a hit, or None."""
    if not isinstance(x, dict):
        return None
    u = x["url"] if isinstance(x.get("url"), str) else x["link"] if isinstance(x.get("link"), str) else None
    if not u or not re.match(r"https?://[a-z.]+/", u):
        return None
    text = lambda *keys: next((x[k] for k in keys if isinstance(x.get(k), str)), "")
    return u, text("title"), text("description", "snippet")


def chosen(items, limit):
    split = lambda s: [w for w in re.split(r"[\W_]+", s.lower()) if len(w) > 1 and w not in rank.STOP_WORDS]
    covered = lambda s: len(set(TERMS) & set(split(s))) / len(TERMS)
    best = {}
    for i, x in enumerate(items):
        if said(x) and (host := said(x)[0].split("/")[2]) not in BLOCKED:
            url, title, snippet = said(x)
            points = round(min(1, 0.55 * covered(title) + 0.3 * covered(snippet) + 0.15 * covered(url) + 0.25 * (" ".join(TERMS) in title)) * 1e6)
            if points >= 120_000 and (url not in best or points > best[url][0]):
                best[url] = (points, -i, host)
    left, out, picks = list(best.values()), set(), Counter()
    while left and len(out) < limit:
        top = max(left, key=lambda b: (b[0] - 80_000 * picks[b[2]], b[0], b[1]))
        left.remove(top)
        out.add(-top[1])
        picks[top[2]] += 1
    return out


def loop(v, limit):
    if isinstance(v, list):
        if any(map(said, v)):
            kept = chosen(v, limit)
            return [x if said(x) else loop(x, limit) for i, x in enumerate(v) if not said(x) or i in kept]
        return [loop(x, limit) for x in v]
    return {k: loop(x, limit) for k, x in v.items()} if isinstance(v, dict) else v


def hit(rng):
    h = {"url": f"https://{rng.choice(['a.org', 'b.org', 'c.net'])}/{rng.choice(WORDS)}{rng.randint(0, 3)}"} if rng.random() < 0.8 else {"url": rng.choice(["nope", 7, None, ""]), "link": "https://d.org/x"}
    if rng.random() < 0.8:
        h["title"] = " ".join(rng.choice(WORDS) for _ in range(3))
    if rng.random() < 0.5:
        h["description"] = rng.choice([" ".join(rng.choice(WORDS) for _ in range(4)), 3])
    if rng.random() < 0.3:
        h["items"] = [hit(rng)]
    return h


def tree(rng, depth):
    r = rng.random()
    if depth == 0 or r < 0.2:
        return rng.choice([1, 'x"é\n', None, True, [], {}, "", 2.5, "[{"])
    if r < 0.5:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] + [hit(rng) for _ in range(rng.randint(0, 4))]
    if r < 0.7:
        return [tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    return {rng.choice(["web", "a b", 'k"q', "é"]): tree(rng, depth - 1) for _ in range(3)}


def test_lists_are_ranked_where_they_stand(spark):
    rng = random.Random(4)
    rows = [(k % 50, json.dumps(tree(rng, rng.randint(0, 8)), ensure_ascii=False)) for k in range(80)] + [(1, None), (2, "{bad"), (3, "[]"), (3, "[]")]
    table = spark.createDataFrame(rows, "row long, payload string")  # a column named as the operator's own
    made = nested.filter_and_rank(table, ["solar wind energy"], 3, SourcePolicy(blocked=tuple(BLOCKED)))
    plain = lambda p: p if p in (None, "{bad") else json.dumps(json.loads(p), sort_keys=True)
    want = Counter((k, plain(p) if p in (None, "{bad") else json.dumps(loop(json.loads(p), 3), sort_keys=True)) for k, p in rows)
    assert made.columns == table.columns and Counter((r.row, plain(r.payload)) for r in made.collect()) == want
    assert nested.filter_and_rank(table.limit(0), ["solar"], 3).count() == 0


def empty(v):
    return v is None or (isinstance(v, str) and not v.strip()) or v == []


def misses(schema, v, path, out, depth=0):
    if depth > 6:
        return
    if isinstance(schema, list):
        if not isinstance(v, list) or not v:
            out.append(path + "[]")
        elif schema and not isinstance(schema[0], (list, dict)):
            out += [path + "[] (one or more items empty)"] * any(map(empty, v))
        elif schema:
            for i, x in enumerate(v):
                misses(schema[0], x, f"{path}[{i}]", out, depth + 1)
    elif isinstance(schema, dict):
        if not isinstance(v, dict):
            out.append(path or "(root)")
            return
        for k, inner in schema.items():
            at = f"{path}.{k}" if path else k
            if k not in v:
                out.append(at)
            elif isinstance(inner, (list, dict)):
                misses(inner, v[k], at, out, depth + 1)
            elif empty(v[k]):
                out.append(at)
    elif empty(v):
        out.append(path or "(root)")


def test_conformance_names_items(spark):
    rng = random.Random(5)

    def made(schema):
        if rng.random() < 0.15:
            return rng.choice([None, "", [], {}, 0, "  ", False, "x"])
        if isinstance(schema, list):
            return [made(schema[0] if schema else 1) for _ in range(rng.randint(0, 3))]
        if isinstance(schema, dict):
            return {k: made(x) for k, x in schema.items() if rng.random() < 0.85} | ({"zz": 1} if rng.random() < 0.2 else {})
        return rng.choice([1, "x", "", None, [1], []])

    deep = {"a": [{"a": [{"a": [{"a": [{"a": None}]}]}]}]}
    for schema in ({"a": None, "b": [{"c": None, "d": [None], "e": {"f": [{"g": None}]}}]}, deep, [{"a": None}], [[None]], {}, None, []):
        docs = [made(schema) for _ in range(40)]
        table = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k long, j string")
        for d, r in zip(docs, table.select("k", nested.conformance(F.col("j"), schema).alias("c")).orderBy("k").collect()):
            want = []
            misses(schema, d, "", want)
            extra = [k for k in d if k not in schema] if isinstance(schema, dict) and isinstance(d, dict) else []
            assert list(r.c.missing) == want and sorted(r.c.extra) == sorted(extra)


def test_inner_values(spark):
    plan = Plan((), transforms=(("website", "NORMALIZE_URL"), ("n", "PARSE_NUMBER")))
    cases = {
        '{"b":{"d":1,"c":[{"y":1,"x":2}]}}': '{"b":{"c":[{"x":2,"y":1}],"d":1}}',
        '{"Work Email":" A@B.C ","country":"uk","list":[" n/a ",null,["",[]]],"o":{"phone":"+49 (30) 123 456","x":"  a   b ","z":null,"t":true},"salary":"$5k","website":"x.org/","n":"2k"}':
            '{"Work Email":"a@b.c","country":"United Kingdom","list":null,"n":2000,"o":{"phone":"+4930123456","t":true,"x":"a b","z":null},"salary":"USD 5000","website":"https://x.org/"}',
        "[]": None, '" N/A "': None, '"  hi "': '"hi"', "null": None, '[["a"],[" "],{"k":[]}]': '[["a"],{"k":null}]', '{"a":"q\\"\\\\ {[,:"}': '{"a":"q\\"\\\\ {[,:"}', '{"email":["A@B.C",{"x":"A"}]}': '{"email":["a@b.c",{"x":"A"}]}',
    }
    table = spark.createDataFrame([(j,) for j in cases], "j string")
    assert {r.j: r.made for r in table.select("j", nested.normal_json(F.col("j"), "address", plan).alias("made")).collect()} == cases
    long = json.dumps({"a": ["\\n\"" * 20_000, " x "]})
    assert json.loads(spark.range(1).select(nested.normal_json(F.lit(long), "a", plan)).first()[0])["a"][1] == "x"


def test_entries_are_taken_apart_once(spark):
    """What a document lacks and what it has beyond the schema come from one map of its entries."""
    from siftwork.operators import nested

    docs = spark.createDataFrame([('{"a":" ","c":1}',), ('{"a":1}',), ("[1]",), ("no JSON",), (None,)], "doc string")
    made = docs.select(nested.conformance(docs.doc, {"a": None}).alias("f"))
    assert [(r.f.missing, r.f.extra) for r in made.collect()] == [(["a"], ["c"]), ([], []), (["(root)"], []), (["(root)"], []), (["(root)"], [])]
    assert made._jdf.queryExecution().analyzed().toString().count("MapType") == 1
