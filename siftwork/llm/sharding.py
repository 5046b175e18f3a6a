"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document begins in a shard drawn from its id, its text
and its ordinal among equal ones, which together are its key: a rerun gives equal rows, however the
input is split. Then
joins move linked documents: a group's documents count by shard, and each document wants to go to
the shard that holds most of its group. Moves into a shard are limited by the room it has below
its quota; of more candidates than there is room for, those go whose draw is lowest. It ends when
nothing moves or after ``ROUNDS``. Then groups are settled as wholes: the driver packs them by size,
largest first, and what propagation brought together stays if its shard has room. Unlinked documents
have no neighbours: they fill the shards up to their quotas, so counts differ by one at most (law
``rows``).

A group larger than a quota fills one shard after the other. Of the groups that a quota can hold,
fewer than there are shards are cut, and only if no shard has room for them. No group is ever
collected: groups are summed to at most one row a shard, and the driver sees counts by shard and
draw, whose number is fixed, and by size and shard, whose number grows with the root of the rows.
Numbers within shards come from counts by bucket, not from a sort of a shard.

Defined cases: a null text has size 1, checksum 0 and no links; ids may repeat or be null (each
row gets a place); fewer rows than shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm._common import materialize, unroll, workspace

LOG = logging.getLogger(__name__)
#: Draws are told apart in so many steps when moves exceed the room.
DRAWS = 4096
ROUNDS = 12
#: A shard may hold one part in so many above its quota while groups move.
SLACK = 20
#: Rows of a bucket, within which rows are numbered by one task.
BUCKET = 10_000


def _buckets(rows: int) -> int:
    return max(64, rows // BUCKET)


def _counts(df: DataFrame, *by: str) -> dict[tuple, int]:
    """Rows by columns with few values."""
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}


def _room(used: list[int], quota: list[int]) -> list[int]:
    return [max(0, q - u) for u, q in zip(used, quota)]


def propagate(linked: DataFrame, quota: list[int], path: str, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (row, group, n, shard) with the shards after label propagation under ``quota`` rows a shard.

    A group's goal is the shard that most of its rows are in, or, if that is full, the one with
    room where most of the others are; a group that the room can hold goes there as a whole. Of
    a group that it can't hold, only rows from shards with fewer of it go. A group that came
    together never moves again, so every round makes progress. Each round is one job over ids
    and groups, written to ``path``.
    """
    n = len(quota)
    for k in range(rounds):
        used = [0] * n
        for (shard,), c in _counts(linked, "shard").items():
            used[shard] = c
        room = _room(used, quota)
        free = F.array(*[F.lit(r) for r in room])
        held = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("n"))
        # ties fall by hash, so that no shard fills before the others
        rank = F.struct(F.col("held"), F.xxhash64("group", "shard").alias("tie"), F.col("shard"))
        best = held.groupBy("group").agg(F.max(F.when(free[F.col("shard")] > 0, rank)).alias("open"), F.count(F.lit(1)).alias("parts")).where("parts > 1 and open is not null")
        here = held.join(best.select(F.col("group").alias("_group"), "open"), F.col("group") == F.col("_group"))
        fits = F.col("n") - F.col("open.held") <= free[F.col("open.shard")]
        goes = (F.col("open.shard") != F.col("shard")) & (fits | (rank < F.col("open")))
        moves = here.where(goes).select("_group", F.col("shard").alias("_shard"), F.col("open.shard").alias("goal"), fits.alias("whole"))
        wished = linked.join(moves, (F.col("group") == F.col("_group")) & (F.col("shard") == F.col("_shard")), "left")
        draw = F.pmod(F.when(F.col("whole"), F.xxhash64("group", F.lit(k))).otherwise(F.xxhash64("group", "row", F.lit(k))), F.lit(DRAWS))
        wished = materialize(wished.select("row", "group", "n", "shard", "goal", F.when(F.col("goal").isNotNull(), draw).alias("draw")), f"{path}/wish-{k}")
        asked = _counts(wished.where("goal is not null"), "goal", "draw")
        limit, moved = [0] * n, 0
        for goal in range(n):
            total = 0
            for d in range(DRAWS):
                c = asked.get((goal, d), 0)
                if total + c > room[goal]:
                    break
                total, limit[goal] = total + c, d + 1
            moved += total
        if not moved:
            return linked
        limits = F.array(*[F.lit(x) for x in limit])
        accepted = F.col("goal").isNotNull() & (F.col("draw") < limits[F.col("goal")])
        linked = wished.select("row", "group", "n", F.when(accepted, F.col("goal")).otherwise(F.col("shard")).cast("int").alias("shard"))
    LOG.info("label propagation was cut after %d rounds with documents still moving; settle places what is left", rounds)
    return linked


def pack(tally: dict[tuple, int], quota: list[int], stay: bool = True) -> tuple[dict[tuple, list[tuple]], list[tuple]]:
    """Where groups go, from the number of groups by (rows, shard; -1 for a group in several).

    First (groups, shard) runs by key of ``tally``; groups beyond them are cut: second (key, (rows,
    shard) runs) of each. Groups come by size, largest first, each to the shard with the least room
    that holds it (with ``stay`` to its own before). Those that no quota holds are cut at once,
    the others that don't fit when all are placed. A group doesn't fit if it is larger than any
    room, and the rooms hold all that is left, so these are fewer than the shards.
    """
    room, runs, cuts, late = list(quota), defaultdict(list), [], []

    def pour(key: tuple) -> None:
        n, parts = key[0], []
        while n:
            shard = min(range(len(room)), key=lambda k: (room[k] < n, room[k] if room[k] >= n else -room[k]))
            took = min(n, room[shard])
            room[shard] -= took
            n -= took
            parts.append((took, shard))
        cuts.append((key, parts))

    cells = defaultdict(dict)
    for (n, at), c in sorted(tally.items()):
        cells[n][at] = c
    for n in sorted(cells, reverse=True):
        left = cells[n]
        if n > max(quota):
            for at, c in left.items():
                for _ in range(c):
                    pour((n, at))
            continue
        for own in (True, False) if stay else (False,):
            for shard in sorted(range(len(room)), key=room.__getitem__):
                for at in [shard] if own else sorted(left, key=lambda k: k != shard):
                    k = min(left.get(at, 0), room[shard] // n)
                    if k:
                        left[at] -= k
                        room[shard] -= k * n
                        runs[n, at].append((k, shard))
        late += [(n, at) for at, c in left.items() for _ in range(c)]
    for key in late:
        pour(key)
    if late and stay:
        other = pack(tally, quota, False)
        if len(other[1]) < len(cuts):
            return other
    return dict(runs), cuts


def _table(of: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of integers from the driver; as Arrow, since a plain list would start Python on the executors."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [pa.array(x, pa.int32() if t.endswith("int") else pa.int64()) for x, t in zip(zip(*rows), schema.split(", "))]
    return of.sparkSession.createDataFrame(pa.table(columns, names))


def _run(rows: DataFrame, by: str, n: str, runs: list[tuple], name: str) -> DataFrame:
    """``rows`` with the value of the run (by, first number, number after the last, value) that the number ``n`` is in; ``runs`` are few."""
    table = _table(rows, runs, "_by int, _from long, _to long, _value int")
    on = (F.col(by) == F.col("_by")) & (F.col(n) >= F.col("_from")) & (F.col(n) < F.col("_to"))
    return rows.join(F.broadcast(table), on).drop("_by", "_from", "_to", n).withColumnRenamed("_value", name)


def settle(linked: DataFrame, quota: list[int], buckets: int, path: str) -> DataFrame:
    """``linked`` with groups as wholes where ``pack`` puts them and no shard above its quota."""
    groups = linked.groupBy("group").agg(F.max("n").alias("n"), F.when(F.min("shard") == F.max("shard"), F.min("shard")).otherwise(-1).alias("at"))
    groups = materialize(groups, f"{path}/wholes")
    tally = _counts(groups, "n", "at")
    runs, cuts = pack(tally, quota)
    moved = sorted(key for key, c in tally.items() if runs.get(key) != [(c, key[1])])
    if not moved:
        return linked
    n, cell_of = len(quota), {key: k for k, key in enumerate(moved)}
    # groups of a cell go to their runs by number; values from n on are cuts
    spans, at, pieces = [], [0] * len(moved), []
    for key in moved:
        for c, shard in runs.get(key, []):
            cell = cell_of[key]
            spans.append((cell, at[cell], at[cell] + c, shard))
            at[cell] += c
    for k, (key, parts) in enumerate(cuts):
        cell, first = cell_of[key], 0
        spans.append((cell, at[cell], at[cell] + 1, n + k))
        at[cell] += 1
        for c, shard in parts:
            pieces.append((n + k, first, first + c, shard))
            first += c
    cells = _table(groups, [(*key, cell) for key, cell in cell_of.items()], "n long, at int, cell int")
    some = number(groups.join(F.broadcast(cells), ["n", "at"]).select("cell", F.col("group").alias("row")), "cell", buckets, "k")
    goals = materialize(_run(some, "cell", "k", spans, "goal").select(F.col("row").alias("_group"), "goal"), f"{path}/goals")
    rows = linked.join(goals, F.col("group") == F.col("_group"), "left")
    rows = materialize(rows.select("row", "group", "n", F.coalesce("goal", "shard").alias("shard")), f"{path}/settled")
    if not pieces:
        return rows
    cut = _run(number(rows.where(F.col("shard") >= n).withColumnRenamed("shard", "cut"), "cut", buckets, "k"), "cut", "k", pieces, "shard")
    return rows.where(F.col("shard") < n).unionByName(cut.select("row", "group", "n", "shard"))


def number(rows: DataFrame, by: str | None, buckets: int, name: str) -> DataFrame:
    """``rows`` (with a column row) and a gapless number from 0, within each value of ``by``, which has few values.

    A bucket's rows are numbered by one task, from the sum of the buckets before it on. The
    table of sums has a row for each bucket.
    """
    keys = [by] if by else []
    rows = rows.withColumn("_key", F.xxhash64("row")).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    sums = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys, "_bucket").orderBy("_key", "row")
    return rows.join(sums, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.row_number().over(within) - 1).drop("_bucket", "_before", "_key")


def shard(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    path = workspace(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("group"),
    ).groupBy("doc_id", "size", "text_crc32", "group").agg(F.count(F.lit(1)).alias("times"))
    key = F.unhex(F.md5(F.to_json(F.struct("doc_id", "group", "nth"))))
    rows = materialize(unroll(rows, "times", "nth").withColumn("row", key).drop("nth"), f"{path}/rows")
    total = rows.count()
    buckets = _buckets(total)
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    groups = rows.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups, f"{path}/groups")  # a table of its own: Spark can then split a hot group's side of the join
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    linked = materialize(rows.join(groups, "group").select("row", "group", "n", start.alias("shard")), f"{path}/linked")
    # a little slack lets groups pass each other; settle holds the quotas
    loose = [q + q // SLACK + 1 for q in quota]
    placed = materialize(settle(propagate(linked, loose, path, rounds), quota, buckets, path).select("row", "shard"), f"{path}/placed")
    used = [0] * shards
    for (k,), c in _counts(placed, "shard").items():
        used[k] = c
    rest = number(rows.select("row").join(placed, "row", "left_anti"), None, buckets, "n")
    ends, at = [], 0
    for r in _room(used, quota):
        at += r
        ends.append(at)
    rest = rest.select("row", _interval(F.col("n"), ends).alias("shard"))
    slots = number(placed.unionByName(rest), "shard", buckets, "slot")
    return rows.join(slots, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _interval(n: Column, ends: list[int]) -> Column:
    out = None
    for k, end in enumerate(ends):
        out = F.when(n < end, F.lit(k)) if out is None else out.when(n < end, F.lit(k))
    return out.cast("int")
