"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document of a source should be copied ``target / source size`` times on average. The whole
part is fixed; the fractional parts are rounded by the pivotal method: two documents meet, and
words move at random from one to the other until the copies of one of the two are integral; the
other goes on with the rest. The chances are such that the expected copies of each document are
kept, and the words of a source stay the same up to the last document that is left.

Documents meet in blocks of about ``BLOCK`` of one source and nearly one size. A block leaves at
most one fractional document. These residuals meet in blocks of the next, coarser level, the
largest first: a reduction tree whose levels shrink by the size of a block. The blocks come from
hashes, so neither a hot source nor a common size makes a large group.

Reruns agree, however the input is split: rows with the same contents are counted, and each row is
its contents and its ordinal among the equal ones. All draws and blocks are hashed from that and
a seed; nothing depends on where a row lies. Sums over sources are exact (whole numbers or
decimals), so their order doesn't matter either.

Defined cases: a null text has size 0; null sources form the last source; repeated rows are
rounded one by one, each with its own copies; an empty table gives an empty result; other columns
are carried through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm._common import WORD, let, materialize, row_key, uniform, unroll, workspace

#: Rows that meet in a block on average.
BLOCK = 64
#: Tasks that the rows of one source and size are dealt to when they are matched with their number of blocks.
SALTS = 16
#: Sizes within a level's factor share blocks; the last level joins all sizes of a source.
LEVELS = (1.02, 1.25, 3.0)
#: Fixed values of the query: weights by turns, share of all sizes, most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0

#: Amounts of words in exact sums.
WORDS = "decimal(38,6)"
#: Probabilities nearer to 0 or 1 count as integral.
EDGE = 1e-9


def sizes(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame, path: str) -> DataFrame:
    """``sources`` with ``_rank`` from 0 in code point order, null last: sorted by ranges, whose counts give the offsets."""
    order = (F.col("source").isNull(), F.col("source"))
    rows = materialize(sources.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), f"{path}/ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offsets = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return rows.join(F.broadcast(offsets), "_range").withColumn("_rank", F.col("_offset") + within - 1).drop("_range", "_offset")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, path: str | None = None) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``weight`` and ``target``.

    Sources take ``weights`` by turns in code point order, null last. What goes above ``most``
    times a source's size is shared again by weight among the others, until no source is above:
    each round sums what the full sources hold and the weights of the others, and the driver sees
    these two numbers. The sources may be as many as the documents.
    """
    path = path or workspace(sources.sparkSession, "targets")
    turns = F.array(*[F.lit(int(w)) for w in weights])
    rows = _ranked(sources, path).withColumn("weight", F.get(turns, F.pmod("_rank", F.lit(len(weights))).cast("int")))
    rows = materialize(rows.select("source", "source_size", "weight", (F.col("source_size") * F.lit(float(most))).cast(WORDS).alias("_cap")), f"{path}/weights")
    size = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full_before = 0.0, -1
    while True:
        full = (F.col("_cap") <= F.col("weight") * F.lit(level)) if full_before >= 0 else F.lit(False)
        n, held, open_ = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == full_before or not open_:
            break
        level, full_before = (size * share - float(held or 0)) / open_, n
    filled = F.col("_cap").cast("double")
    return rows.select("source", "source_size", "weight", (F.least(filled, F.col("weight") * F.lit(level)) if open_ else filled).alias("target"))


def _meet(items: Column, item_type: str, seed: int) -> Column:
    """Array of the items of a block after all met in turn; the last is the residual, possibly fractional."""
    zero = F.struct(F.get(items, 0).cast(item_type).alias("open"), F.array().cast(f"array<{item_type}>").alias("done"))
    item = lambda d, p: F.struct(d["row"].alias("row"), d["size"].alias("size"), F.when(p < EDGE, 0.0).when(p > 1 - EDGE, 1.0).otherwise(p).alias("p")).cast(item_type)

    def step(acc: Column, x: Column) -> Column:
        a = acc["open"]
        # words that can move from x to a, and from a to x
        to_a = F.least((1.0 - a["p"]) * a["size"], x["p"] * x["size"])
        to_x = F.least(a["p"] * a["size"], (1.0 - x["p"]) * x["size"])
        u = uniform(a["row"], a["size"], x["row"], x["size"], F.lit(seed))
        words = F.when(u * (to_a + to_x) < to_x, to_a).otherwise(-to_x)
        moved = F.array(item(a, a["p"] + words / a["size"]), item(x, x["p"] - words / x["size"]))
        settled = (a["p"] == 0) | (a["p"] == 1)

        def goes_on(m: Column) -> Column:
            first_done = (m[0]["p"] == 0) | (m[0]["p"] == 1)
            return F.struct(F.when(first_done, m[1]).otherwise(m[0]).alias("open"), F.concat(acc["done"], F.array(F.when(first_done, m[0]).otherwise(m[1]))).alias("done"))

        return F.when(settled, F.struct(x.cast(item_type).alias("open"), F.concat(acc["done"], F.array(a)).alias("done"))).otherwise(let(moved, goes_on))

    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1))), zero, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def _level(items: DataFrame, factor: float | None, seed: int) -> DataFrame:
    """All items after one level. factor None: all sizes of a source share blocks."""
    item_type = f"struct<row:{items.schema['row'].dataType.simpleString()},size:bigint,p:double>"
    band = F.lit(0) if factor is None else F.floor(F.log(F.col("size") + 1.0) / F.log(F.lit(factor))).cast("int")
    items = items.withColumn("_band", band)
    parts = items.groupBy(F.col("source").alias("_source"), F.col("_band").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_parts"))
    # salted, as one source and size may have a third of all rows
    parts = parts.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    items = items.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_band") == F.col("_of")) & (F.col("_salt") == F.col("_to"))
    dealt = items.join(parts, same).select("source", "_band", "row", "size", "p", F.pmod(F.xxhash64("row", "size", F.lit(seed)), F.col("_parts")).alias("_part"))
    # largest first within the block: neighbours in size meet, and what is left at the end is small
    block = F.transform(F.sort_array(F.collect_list(F.struct("size", "row", "p")), asc=False), lambda x: F.struct(x["row"].alias("row"), x["size"].alias("size"), x["p"].alias("p")).cast(item_type))
    met = dealt.groupBy("source", "_band", "_part").agg(block.alias("_items")).select("source", F.explode(let(F.col("_items"), lambda x: _meet(x, item_type, seed))).alias("x"))
    return met.select("source", "x.row", "x.size", "x.p")


def pivotal(items: DataFrame, path: str, seed: int = 0) -> DataFrame:
    """Rounds ``p`` (in [0, 1]) of ``items`` (source, row, size, p); each source's words change by less than one item's size.

    ``row`` tells the items of a source apart; it may be a struct of all that must travel along. Each level is written to ``path``: what it decided, and the residuals that the next one reads.
    It ends when no source has two residuals; a last draw rounds what is left of a source.
    """
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    near = F.when(F.col("p") < EDGE, 0.0).when(F.col("p") > 1 - EDGE, 1.0).otherwise(F.col("p"))
    # items without words have nothing to move
    alone = F.when(uniform("row", F.lit(seed)) < F.col("p"), 1.0).otherwise(0.0)
    items = items.withColumn("p", F.when(F.col("size") == 0, alone).otherwise(near))
    done, rest, k = [items.where(~fractional)], items.where(fractional), 0
    while True:
        level = materialize(_level(rest, LEVELS[k] if k < len(LEVELS) else None, seed + k), f"{path}/level-{k}")
        done.append(level.where(~fractional))
        rest, k = level.where(fractional), k + 1
        if k >= len(LEVELS) and rest.groupBy("source").count().where("count > 1").isEmpty():
            break
    last = F.when(uniform("row", "size", F.lit(seed - 1)) < F.col("p"), 1.0).otherwise(0.0)
    done.append(rest.withColumn("p", last))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def copies(rows: DataFrame, path: str, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``rows`` (source, size, and id: what else tells rows apart) by their contents: source, size, id, source_size, target and copies; one row for each of ``rows``."""
    rows = materialize(rows.groupBy("source", "size", "id").agg(F.count(F.lit(1)).alias("n")), f"{path}/rows")
    known = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most, path)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = materialize(known.select(F.col("source").alias("_source"), "source_size", "target", F.floor(times).alias("whole"), (times - F.floor(times)).alias("p")), f"{path}/targets")
    wide = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
    wide = wide.select("source", "size", "p", "n", "id", "source_size", "target", "whole")
    items = unroll(wide, "n", "nth").select("source", "size", "p", F.struct("id", "nth", "source_size", "target", "whole").alias("row"))
    rounded = pivotal(items, path, seed)
    return rounded.select("source", "size", "row.id", "row.source_size", "row.target", (F.col("row.whole") + F.col("p").cast("long")).alias("copies"))


def plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    found = copies(docs.select("source", sizes(F.col("text")).alias("size"), F.col("doc_id").alias("id")), workspace(docs.sparkSession, "mix"), seed)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each document repeated by its copies, with all its columns.

    Rows that are equal in all columns share one key; one of them stands for all their copies.
    """
    path, columns = workspace(docs.sparkSession, "mix"), docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), row_key(*columns).alias("_key"))
    found = copies(keyed.select(F.col("_doc.source").alias("source"), sizes(F.col("_doc.text")).alias("size"), F.col("_key").alias("id")), path, seed)
    taken = materialize(found.groupBy(F.col("id").alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).where("copies > 0"), f"{path}/taken")
    one = keyed.join(taken.where("n = 1"), "_key").select("_doc", "copies")
    often = keyed.join(taken.where("n > 1"), "_key").groupBy("_key").agg(F.any_value("_doc").alias("_doc"), F.any_value("copies").alias("copies")).select("_doc", "copies")
    rows = unroll(one.unionByName(often), "copies", "nth")
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])
