"""Source governance: decisions on URLs, robots rules, sliding-window limits, retries and lifecycles."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions import urls
from siftwork.functions.text import redact
from siftwork.operators.store import settled
from siftwork.plans.model import SourcePolicy

#: Longest crawl delay, size of a robots file that is read, agent that asks.
MAX_DELAY_MS, ROBOTS_CHARS, AGENT = 60_000, 512 * 1024, "SiftworkBot"
#: Tasks that an origin's requests are dealt to.
SALTS = 16
#: Calls of a limiter's segment, stretches by which it is warmed up, rounds of mending.
SEGMENT, WARM, ROUNDS = 200_000, 4, 8
LIFECYCLE = ("DISCOVERED", "ALLOWED", "BLOCKED", "QUEUED", "PROCESSING", "COLLECTED", "FAILED", "SKIPPED")


def decide(sources: DataFrame, policy: SourcePolicy, url: str = "url", international: bool = False) -> DataFrame:
    """``sources`` with canonical_url, domain, url_hash, allowed and code: the first reason that applies, or null. ``international`` brings hosts beyond ASCII to ASCII first."""

    def judged(p: urls.Parts) -> Column:
        host = F.regexp_replace(p.host, r"\.$", "")

        def told(hidden: Column) -> Column:
            code = (
                F.when(~p.is_url, "INVALID_URL")
                .when(~p.is_http, "UNSUPPORTED_SCHEME")
                .when(p.user != "", "URL_CREDENTIALS_BLOCKED")
                .when(hidden, "NON_PUBLIC_HOST_BLOCKED")
                .when(urls.matches_rules(host, policy.blocked), "DOMAIN_DENYLISTED")
            )
            if policy.allowed:
                code = code.when(~urls.matches_rules(host, policy.allowed), "DOMAIN_NOT_ALLOWLISTED")
            return F.struct(F.coalesce(urls.source_of(p, hidden), urls.safe_of(p)).alias("canonical_url"), F.when(p.is_url, host).otherwise("").alias("domain"), code.alias("code"))

        return F.transform(F.array(urls.non_public_host(host)), told)[0]

    # all that is told of a URL comes from its parts in one pass
    if international:
        sources = sources.withColumn(url, urls.with_ascii_host(F.col(url)))
    out = sources.withColumn("_judged", urls.with_parts(F.col(url), judged))
    out = out.withColumns({"canonical_url": F.col("_judged.canonical_url"), "domain": F.col("_judged.domain"), "code": F.col("_judged.code")})
    return out.withColumns({"url_hash": F.sha2("canonical_url", 256), "allowed": F.col("code").isNull()}).drop("_judged")


def safe_addresses(addresses: Column) -> Column:
    """Whether a host's resolved addresses are there and all public."""
    bad = lambda a: F.when(a.contains(":"), urls.non_public_ipv6(F.lower(a))).otherwise(urls.non_public_ipv4(a))
    return F.coalesce((F.size(addresses) > 0) & ~F.exists(addresses, bad), F.lit(False))


def robots_rules(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """origin, allow, path, delay_ms of the rules that hold for an agent.

    ``files``: origin, body. Lines are numbered and grouped by window: a user-agent line begins a
    group unless it follows another one directly. Groups that name the agent count, else those
    for all; their longest delay holds.
    """
    lines = files.select("origin", F.posexplode(F.split(F.substring("body", 1, ROBOTS_CHARS), r"\r?\n")).alias("at", "line"))
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    lines = lines.withColumn("line", line).where(F.col("line").contains(":"))
    lines = lines.select("origin", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    w = W.partitionBy("origin").orderBy("at")
    begins = (F.col("name") == "user-agent") & ~F.coalesce(F.lag("name").over(w) == "user-agent", F.lit(False))
    lines = lines.withColumn("group", F.sum(F.when(begins, 1).otherwise(0)).over(w)).where("group > 0")
    me = re.split(r"[\s/]", agent.lower())[0]
    named = F.col("name") == "user-agent"
    token = F.lower("value")
    groups = lines.groupBy("origin", "group").agg(
        F.bool_or(named & (token != "*") & F.lit(me).contains(token)).alias("mine"), F.bool_or(named & (token == "*")).alias("all"),
        F.last(F.when((F.col("name") == "crawl-delay") & F.col("value").rlike(r"^\d+(?:\.\d+)?$"), F.least(F.lit(MAX_DELAY_MS), F.col("value").try_cast("double") * 1000)), ignorenulls=True).alias("delay"),
    )
    chosen = groups.groupBy("origin").agg(F.bool_or("mine").alias("any_mine"))
    groups = groups.join(chosen, "origin").where(F.when(F.col("any_mine"), F.col("mine")).otherwise(F.col("all"))).select("origin", "group", "delay")
    delays = groups.groupBy("origin").agg(F.max("delay").cast("long").alias("delay_ms"))
    rules = lines.where(F.col("name").isin("allow", "disallow") & (F.col("value") != "")).join(groups, ["origin", "group"])
    rules = rules.select("origin", (F.col("name") == "allow").alias("allow"), F.col("value").alias("path"))
    return delays.join(rules, "origin", "left").select("origin", "allow", "path", "delay_ms")


class Rules:
    """The compiled rules of one origin: a trie of literal prefixes, whole paths, and the patterns with wildcards from the strongest down.

    A rule's strength is its length without ``*`` and ``$``; among equals allowing wins.
    """

    def __init__(self) -> None:
        self.trie: dict = {}
        self.whole: dict[str, tuple[int, bool]] = {}
        self.patterns: list[tuple[tuple[int, bool], re.Pattern]] = []
        self.delay: int | None = None
        self.status: int | None = None

    def add(self, path: str, allow: bool) -> None:
        strength = (len(re.sub(r"[*$]", "", path)), allow)
        if "*" in path:
            body = ".*".join(map(re.escape, path.removesuffix("$").split("*")))
            self.patterns.append((strength, re.compile(body + "$" * path.endswith("$"))))
        elif path.endswith("$"):
            self.whole[path[:-1]] = max(strength, self.whole.get(path[:-1], strength))
        else:
            node = self.trie
            for c in path:
                node = node.setdefault(c, {})
            node[""] = max(strength, node.get("", strength))

    def seal(self) -> None:
        self.patterns.sort(key=lambda p: p[0], reverse=True)

    def allowed(self, target: str) -> bool:
        best, node = self.whole.get(target, (-1, True)), self.trie
        for c in target:
            node = node.get(c)
            if node is None:
                break
            best = max(best, node.get("", best))
        for strength, pattern in self.patterns:
            if strength <= best:
                break
            if pattern.match(target):
                return strength[1]
        return best[1]


def _ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by origin, its rules before the requests: compiles the rules, then decides request by request."""
    now, held = object(), Rules()
    for b in batches:
        verdicts, delays, statuses, sealed = [], [], [], False
        columns = (b.column(c).to_pylist() for c in ("_origin", "_salt", "_rule", "_allow", "_path", "_delay", "_status", "_target"))
        for origin, salt, rule, allow, path, delay, status, target in zip(*columns):
            if (origin, salt) != now:
                now, held, sealed = (origin, salt), Rules(), False
            if rule:
                if path is not None:
                    held.add(path, allow)
                held.delay = max((d for d in (held.delay, delay) if d is not None), default=None)
                held.status = status if held.status is None else held.status
                sealed = False
                continue
            if not sealed:
                held.seal()
                sealed = True
            verdicts.append(target is None or held.allowed(target))
            delays.append(held.delay)
            statuses.append(held.status)
        asked = b.filter(pc.invert(b.column("_rule")))
        yield pa.RecordBatch.from_arrays([asked.column("_old"), pa.array(verdicts, pa.bool_()), pa.array(delays, pa.int64()), pa.array(statuses, pa.int32())], names=["_old", "_verdict", "delay_ms", "_status"])


def robots_decisions(requests: DataFrame, rules: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """``requests`` (id, url) with origin, delay_ms, robots_status and allowed; each stays one row, repeated ids too.

    The longest matching rule decides, allow before disallow on ties. ``responses`` (origin,
    status; one row an origin) tells how the files were answered: 404 and 410 allow, other failures forbid.
    An origin's rules go once to each of ``SALTS`` tasks, which compile them and see a part of its requests.
    """
    asked = urls.with_parts(F.col("url"), lambda p: F.struct(F.concat(p.scheme, F.lit("://"), p.authority).alias("origin"), F.concat(p.path, p.query).alias("target")))
    old = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    target = requests.select(old.alias("_old"), asked.alias("_asked")).select("_old", F.col("_asked.origin").alias("_origin"), F.col("_asked.target").alias("_target"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    target = target.select(
        "_origin", F.pmod(F.xxhash64("_target"), F.lit(SALTS)).cast("int").alias("_salt"), F.lit(False).alias("_rule"), none("boolean", "_allow"), none("string", "_path"), none("long", "_delay"), none("int", "_status"), "_target",
        F.struct(F.struct("_old.*").alias("row"), F.col("_origin").alias("origin")).alias("_old"),
    )
    kind = target.schema["_old"].dataType.simpleString()
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    known = rules.select(F.col("origin").alias("_origin"), salt, F.lit(True).alias("_rule"), F.col("allow").alias("_allow"), F.col("path").alias("_path"), F.col("delay_ms").cast("long").alias("_delay"), none("int", "_status"), none("string", "_target"), none(kind, "_old"))
    both = target.unionByName(known)
    if responses is not None:
        told = responses.select(F.col("origin").alias("_origin"), salt, F.lit(True).alias("_rule"), none("boolean", "_allow"), none("string", "_path"), none("long", "_delay"), F.col("status").cast("int").alias("_status"), none("string", "_target"), none(kind, "_old"))
        both = both.unionByName(told)
    dealt = both.repartition("_origin", "_salt").sortWithinPartitions("_origin", "_salt", F.desc("_rule"))
    out = dealt.mapInArrow(_ruled, f"_old {kind}, _verdict boolean, delay_ms long, _status int")
    status = F.when(F.col("_verdict"), "ALLOWED").otherwise("DISALLOWED")
    if responses is not None:
        s = F.col("_status")
        status = F.when(s.isin(404, 410), "NOT_FOUND").when(s.isNull() | ~s.between(200, 299), "UNAVAILABLE").otherwise(status)
    return out.select("_old.row.*", F.col("_old.origin").alias("origin"), "delay_ms", status.alias("robots_status")).withColumn("allowed", F.col("robots_status").isin("ALLOWED", "NOT_FOUND"))


class Window:
    """Log of the accepted calls of one key; rejected calls leave no trace. The window is (now - width, now]."""

    def __init__(self, limit: int, width_ms: int, interval_ms: int = 0, times: list[int] = ()):
        self.limit, self.width, self.interval, self.times = limit, width_ms, interval_ms, deque(times)

    def ask(self, now: int) -> tuple[bool, int]:
        """(allowed, milliseconds to wait)."""
        while self.times and self.times[0] <= now - self.width:
            self.times.popleft()
        wait = 0
        if len(self.times) >= self.limit:
            wait = max(wait, self.times[0] + self.width - now)
        if self.times and self.interval:
            wait = max(wait, self.times[-1] + self.interval - now)
        if wait <= 0:
            self.times.append(now)
        return wait <= 0, max(0, wait)


_CALL = "part long, segment long, id long, at long, head array<long>, allowed boolean, retry_after_ms long, remaining long, log array<long>"


def _limited(limit: int, width_ms: int, interval_ms: int, kind: str):
    """Meets calls sorted by (key, part, segment, at, id). A row with ``head`` tells the log to begin with; ``warm`` rows only fill it.

    Gives the decisions, and for parts of several segments each segment's log at its begin and at its end.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begin, last = None, None, None, None
        names = ["key", "part", "segment", "id", "at", "head", "allowed", "retry_after_ms", "remaining", "log"]

        def ended() -> list[tuple]:
            if now is None or last is None:
                return []
            log = lambda times, at: [t for t in times if t > at - width_ms]
            return [(*now, None, None, log(begin or (), last[0]), None, None, None, log(state.times, last[1]))]

        for pdf in batches:
            rows = []
            for key, part, segment, i, at, warm, head, first, nxt in zip(*(pdf[c] for c in ("key", "part", "segment", "id", "at", "warm", "head", "first", "next"))):
                key = None if pd.isna(key) else key
                if now is None or (key, part, segment) != now:
                    rows += ended()
                    now, state, begin = (key, part, segment), Window(limit, width_ms, interval_ms), None
                    last = None if pd.isna(first) else (int(first), int(nxt))
                if head is not None:
                    state.times.extend(int(t) for t in head)
                    continue
                if not warm and begin is None:
                    begin = list(state.times)
                ok, wait = state.ask(int(at))
                if not warm:
                    rows.append((*now, i, at, None, ok, wait, max(0, limit - len(state.times)), None))
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(ended(), columns=names)

    return decide, f"key {kind}, {_CALL}"


def limit_calls(calls: DataFrame, limit: int, width_ms: int = 60_000, interval_ms: int = 0) -> DataFrame:
    """``calls`` (key, id, at in ms) with allowed, retry_after_ms, remaining.

    The decision on a call depends on those before it, but not across a time in which the window
    runs empty. So a key's calls are parted where a stretch of the window's width has none, which
    the distinct (key, stretch) tell; each part is met in order by one task. It streams through
    sorted; only the accepted calls of one window are held.

    A part of more than ``SEGMENT`` calls is cut into segments of whole stretches that are met at
    the same time, each on a guess: its log after the ``WARM`` stretches before it. Where the guess
    is the log with which the segment before ended, both are right. The others are met again
    from that log, which mends those behind them as soon as the logs meet. After ``ROUNDS`` rounds
    what is left of a part, which then has calls whose phase never meets, is met in order.
    """
    kind = dict(calls.dtypes)["key"]
    decide, schema = _limited(limit, width_ms, interval_ms, kind)
    at = F.col("at").cast("long")
    calls = calls.select("key", F.col("id").cast("long").alias("id"), at.alias("at"), F.floor(at / F.lit(width_ms)).alias("stretch"))
    # stretches that follow each other have one difference of number and rank
    counted = calls.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"))
    by_key = W.partitionBy("key").orderBy("stretch")
    parts = counted.withColumn("part", F.col("stretch") - F.row_number().over(by_key))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key", "part").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = settled(parts.withColumn("segment", F.floor(before / SEGMENT)))
    several = parts.groupBy("key", "part").agg(F.max("segment").alias("last")).where(F.col("last") > 0)
    plain = [F.lit(False).alias("warm"), F.lit(None).cast("array<long>").alias("head"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("next")]
    meet = lambda rows: rows.repartition("key", "part", "segment").sortWithinPartitions("key", "part", "segment", F.col("at").asc_nulls_first(), "id").mapInPandas(decide, schema)
    same = lambda a, b, *cs: reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), cs, F.lit(True))
    result = ["key", "id", "at", "allowed", "retry_after_ms", "remaining"]
    placed = calls.alias("c").join(parts.alias("p"), same("c", "p", "key", "stretch"))
    if several.isEmpty():
        return meet(placed.select("c.key", "p.part", "p.segment", "c.id", "c.at", *plain)).select(*result)
    spans = parts.groupBy("key", "part", "segment").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    spans = settled(spans.select("key", "part", "segment", "low", (F.col("low") * width_ms).alias("first"), ((F.col("high") + 1) * width_ms).alias("next")))
    # segments are numbered by calls, so the next one may be further than one on
    numbered = W.partitionBy("key", "part").orderBy("segment")
    follows = settled(spans.select("key", "part", "segment", F.lead("segment").over(numbered).alias("after"), F.lead("low").over(numbered).alias("after_low"), F.count(F.lit(1)).over(W.partitionBy("key", "part")).alias("count")))
    near = parts.alias("p").join(follows.alias("f"), same("p", "f", "key", "part", "segment")).where(F.col("after").isNotNull() & (F.col("p.stretch") >= F.col("after_low") - WARM))
    both = parts.select("key", "part", "stretch", "segment", F.lit(False).alias("warm")).unionByName(near.select("p.key", "p.part", "p.stretch", F.col("after").alias("segment"), F.lit(True).alias("warm")))
    told = spans.alias("s").join(follows.alias("f"), same("s", "f", "key", "part", "segment")).where("count > 1").select("s.key", "s.part", "s.segment", "s.first", "s.next")
    dealt = calls.alias("c").join(both.alias("b"), same("c", "b", "key", "stretch")).select("c.key", "b.part", "b.segment", "c.id", "c.at", "b.warm")
    dealt = settled(dealt.alias("d").join(told.alias("t"), same("d", "t", "key", "part", "segment"), "left").select("d.*", F.lit(None).cast("array<long>").alias("head"), "t.first", "t.next"))
    met = settled(meet(dealt))
    links = follows.where("after is not null").select("key", "part", "segment", "after")

    def wrong() -> DataFrame:
        """(key, part, segment, head) of segments that were met with another log than the one before left."""
        logs = met.where("log is not null")
        ends = links.alias("l").join(logs.alias("a"), same("l", "a", "key", "part", "segment")).select("l.key", "l.part", F.col("l.after").alias("segment"), F.col("a.log").alias("end"))
        return settled(ends.alias("e").join(logs.alias("b"), same("e", "b", "key", "part", "segment")).where(F.col("e.end") != F.col("b.head")).select("e.key", "e.part", "e.segment", F.col("e.end").alias("head")))

    for _ in range(ROUNDS):
        todo = wrong()
        if todo.isEmpty():
            return met.where("log is null").select(*result)
        again = dealt.where("not warm").alias("d").join(todo.alias("t"), same("d", "t", "key", "part", "segment"), "left_semi")
        heads = todo.alias("t").join(told.alias("s"), same("t", "s", "key", "part", "segment")).select("t.key", "t.part", "t.segment", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("at"), F.lit(False).alias("warm"), "t.head", "s.first", "s.next")
        met = settled(met.alias("m").join(todo.alias("t"), same("m", "t", "key", "part", "segment"), "left_anti").unionByName(meet(again.unionByName(heads))))
    todo = wrong()
    from_ = settled(todo.groupBy("key", "part").agg(F.min_by(F.struct("segment", "head"), "segment").alias("f")).select("key", "part", F.col("f.segment").alias("from"), F.col("f.head").alias("head")))
    late = lambda rows, how: rows.alias("r").join(from_.alias("f"), same("r", "f", "key", "part") & (F.col("r.segment") >= F.col("f.from")), how)
    rest = late(dealt.where("not warm"), "inner").select("r.key", "r.part", F.col("f.from").alias("segment"), "r.id", "r.at", "r.warm", F.lit(None).cast("array<long>").alias("head"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("next"))
    heads = from_.select("key", "part", F.col("from").alias("segment"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("at"), F.lit(False).alias("warm"), "head", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("next"))
    return late(met, "left_anti").where("r.log is null").select(*[f"r.{c}" for c in result]).unionByName(meet(rest.unionByName(heads)).select(*result))


def retry_delay(attempt: Column, initial_ms: int, multiplier: float, most_ms: int, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    """Wait after an attempt: exponential up to a cap, times a jitter factor, not shorter than what the source asks."""
    base = F.least(F.lit(float(most_ms)), F.lit(float(initial_ms)) * F.pow(F.lit(multiplier), attempt - 1))
    base = F.floor(base * jitter + 0.5) if jitter is not None else base
    return F.greatest(base, F.coalesce(retry_after, F.lit(0))) if retry_after is not None else base


def error_class(status: Column, message: Column) -> Column:
    """Kind of a retryable failure, null for others. The words and codes."""
    return (
        F.when(message.rlike(r"(?i)timed?\s*out|timeout"), "TIMEOUT")
        .when(status.isin(429, 408, 425), "RATE_LIMIT")
        .when(status.between(500, 599), "SERVER_ERROR")
        .when(message.rlike(r"(?i)network|socket|fetch failed|econnreset|eai_again|connection"), "TRANSIENT_NETWORK")
    )


def should_retry(kind: Column, attempt: Column, most: int, kinds: tuple[str, ...]) -> Column:
    return F.coalesce(kind.isin(*kinds) & (attempt < most), F.lit(False))


def safe_message(c: Column) -> Column:
    """An error message without known key formats, 500 characters at most."""
    return F.substring(redact(c), 1, 500)


def lifecycle(changes: DataFrame) -> DataFrame:
    """Last state of each (run, url_hash) of ``changes`` (run, url_hash, seq, status, code, reason), and the number of attempts."""
    last = F.max_by(F.struct("status", "code", "reason"), "seq")
    folded = changes.groupBy("run", "url_hash").agg(last.alias("s"), F.count_if(F.col("status") == "PROCESSING").alias("attempts"))
    return folded.select("run", "url_hash", "s.status", "s.code", "s.reason", "attempts")


def governed(requests: DataFrame, policy: SourcePolicy, rules: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """A request table (id, url, at) through all stages: policy, robots, limit. One row a request with status and code."""
    decided = decide(requests, policy)
    passed = robots_decisions(decided.where("allowed").select("id", F.col("canonical_url").alias("url"), "domain", "at"), rules, responses)
    limited = limit_calls(passed.where("allowed").select(F.col("domain").alias("key"), "id", "at"), policy.per_minute)
    out = decided.select("id", "url", "domain", "code").join(passed.select("id", "robots_status"), "id", "left").join(limited.select("id", F.col("allowed").alias("_ok")), "id", "left")
    status = F.when(F.col("code").isNotNull() | (F.col("robots_status") == "DISALLOWED"), "BLOCKED").when((F.col("robots_status") == "UNAVAILABLE") | ~F.col("_ok"), "SKIPPED").otherwise("QUEUED")
    code = F.coalesce("code", F.when(F.col("robots_status") == "DISALLOWED", "ROBOTS_DISALLOW").when(F.col("robots_status") == "UNAVAILABLE", "ROBOTS_UNAVAILABLE").when(~F.col("_ok"), "RATE_LIMIT"))
    return out.select("id", "url", "domain", status.alias("status"), code.alias("code"))


def seeds(prior: Column, own: Column, policy: SourcePolicy, limit: int) -> Column:
    """Distinct start URLs: earlier ones first, public and not blocked, up to a limit."""
    fine = lambda u: urls.source_form(u).isNotNull() & ~urls.matches_rules(urls.host(u), policy.blocked)
    return F.slice(F.array_distinct(F.filter(F.concat(prior, own), fine)), 1, limit)
