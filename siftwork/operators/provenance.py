"""Provenance: which sources support a row and a field, and whether a snippet really says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import urls
from siftwork.functions.text import ONE_SPACE, SPACE
from siftwork.operators.match import salted, settled
from siftwork.sources.tables import TASK_ROWS, dealt

#: Bytes of a table that is sent whole to the tasks, as ``_size`` tells them; more are shuffled.
BROADCAST = 1 << 23
#: Needles at most that are looked for in the texts themselves, if their tokens are too many to be sent.
DIRECT = 32


def verifies(snippet: Column, value: Column) -> Column:
    """Whether a snippet holds a value (two characters or more), or all its words of three characters or more."""
    s, v = F.lower(snippet), F.lower(F.trim(value.cast("string")))
    words = F.filter(F.split(v, f"{SPACE}+"), lambda w: F.length(w) >= 3)
    found = ((F.length(v) >= 2) & s.contains(v)) | ((F.size(words) > 0) & F.forall(words, lambda w: s.contains(w)))
    return F.coalesce((F.trim(snippet) != "") & found, F.lit(False))


def verifies_number(snippet: Column, value: Column) -> Column:
    """A number or truth value is looked for as a whole only."""
    v = F.lower(value.cast("string"))
    return F.coalesce((F.length(v) >= 2) & F.lower(snippet).contains(v), F.lit(False))


def verifies_any(snippet: Column, values: Column) -> Column:
    """Whether a snippet holds an element of an array of texts."""
    return F.coalesce(F.exists(values, lambda x: verifies(snippet, x)), F.lit(False))


def verifies_object(snippet: Column, values: Column) -> Column:
    """Whether a snippet holds a value of a map of texts."""
    return verifies_any(snippet, F.map_values(values))


def _runs(c: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _size(df: DataFrame) -> Column:
    """Bytes that the rows of ``df`` take in a hash table, by an estimate: their texts and something for each row."""
    texts = [name for name, kind in df.dtypes if "string" in kind]
    return F.coalesce(F.sum(F.octet_length(F.concat_ws("", *texts)) + 64), F.lit(0))


def _sent(df: DataFrame) -> DataFrame:
    """``df``, which is settled, for a join: sent whole to the tasks if it is small, else shuffled."""
    return F.broadcast(df) if df.agg(_size(df)).first()[0] <= BROADCAST else df


def _joined(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` with their rows of ``small``, which is settled: that is sent whole to the tasks, or else to those that a key's rows are dealt to."""
    sent = _sent(small)
    return rows.join(sent, key) if sent is not small else salted(rows, small, key, "inner")


def _within(vocabulary: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, token, n of all ``needles`` (needle: without white space) within tokens of ``vocabulary`` (token, n).

    A token holds every run of three characters of a needle (of a shorter one, itself): each needle
    asks for that of its runs which the fewest tokens hold, and who answers is tested.
    """
    width = F.least(F.length("needle"), F.lit(3))
    widths = [r[0] for r in needles.select(width.alias("w")).distinct().collect()]
    none = F.array().cast("array<string>")
    of = lambda c: F.concat(none, *[F.when(width == w, _runs(c, w)).otherwise(none) for w in widths])
    asked = needles.select("needle", F.explode(of(F.col("needle"))).alias("gram"))
    held = vocabulary.select("token", "n", F.explode(F.array_distinct(F.concat(none, *[_runs(F.col("token"), w) for w in widths]))).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rarest = settled(asked.join(often, "gram").groupBy("needle").agg(F.min(F.struct("often", "gram")).alias("m")).select("needle", F.col("m.gram").alias("gram")))
    return _joined(held, rarest, "gram").where(F.col("token").contains(F.col("needle"))).select("needle", "token", "n")


def _direct(wanted: DataFrame) -> list[str]:
    """Needles of ``wanted`` (needle, token, ask) to be looked for in the texts: those with the most tokens, until what is left can be sent, or ``DIRECT`` of them."""
    sizes = settled(wanted.groupBy("needle").agg(_size(wanted).alias("size")))
    left, out = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], []
    for needle, size in sizes.orderBy(F.desc("size"), "needle").limit(DIRECT).collect() if left > BROADCAST else []:
        if left <= BROADCAST:
            break
        out.append(needle)
        left -= size
    return out


def verified_pairs(snippets: DataFrame, values: DataFrame) -> DataFrame:
    """sid, vid of all ``snippets`` (sid, snippet) that verify one of ``values`` (vid, value: text), by ``verifies``.

    A value that has words of three characters or more is verified by all of them; another one, of
    two characters or more, as a whole. Either way a snippet holds certain texts without white space,
    the value's needles, and each of them lies within one token of the snippet. So needles are looked
    for once in the vocabulary of all tokens, and each value asks for the needle whose tokens occur
    least. Few needles that very many tokens hold, as two letters are, are looked for in the texts.
    Values with equal needles are one value here; only those with several needles meet the texts of
    the snippets that answer. What is sent whole to the tasks is bounded; no file's size decides it.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, ONE_SPACE), lambda w: w != ""))
    v = values.where("value is not null and vid is not null").select("vid", F.lower(F.trim("value")).alias("v")).where(F.length("v") >= 2).withColumn("words", words(F.col("v")))
    v = v.withColumn("long", F.filter("words", lambda w: F.length(w) >= 3)).withColumn("worded", F.size("long") > 0)
    members = settled(v.select("vid", F.when(F.col("worded"), F.sort_array("long")).otherwise(F.col("words")).alias("needles"), F.when(~F.col("worded"), F.col("v")).otherwise("").alias("whole")))
    alike = settled(members.groupBy("needles", "whole").agg(F.min("vid").alias("head")))
    # one needle that is all that is asked for needs no further test
    sure = (F.size("needles") == 1) & ((F.col("whole") == "") | (F.col("whole") == F.col("needles")[0]))
    asked = alike.select("head", F.size("needles").alias("size"), sure.alias("sure"), F.explode("needles").alias("needle"))
    s = settled(snippets.where("sid is not null").where(F.trim("snippet") != "").select("sid", F.lower("snippet").alias("s")))
    tokens = s.select("sid", F.explode(words(F.col("s"))).alias("token"))
    vocabulary = settled(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    holds = settled(_within(vocabulary, settled(asked.select("needle").distinct())))
    weights = holds.groupBy("needle").agg(F.sum("n").alias("n"))
    # a value with a needle that no token holds is verified by none
    rarest = asked.join(weights, "needle").groupBy("head", "size", "sure").agg(F.min(F.struct("n", "needle")).alias("m"), F.count(F.lit(1)).alias("held")).where("held = size")
    chosen = settled(rarest.select(F.col("m.needle").alias("needle"), F.struct("head", "sure").alias("ask")))
    wanted = settled(chosen.join(holds.select("needle", "token"), "needle").select("needle", "token", "ask"))
    direct = _direct(wanted)
    met = _joined(tokens, settled(wanted.where(~F.col("needle").isin(direct)).select("token", "ask")), "token").select("sid", "ask")
    if direct:
        said = s.select("sid", F.explode(F.filter(F.array(*map(F.lit, direct)), lambda x: F.col("s").contains(x))).alias("needle"))
        met = met.unionByName(_joined(said, settled(chosen.where(F.col("needle").isin(direct))), "needle").select("sid", "ask"))
    found = settled(met.select("sid", "ask.head", "ask.sure").distinct())
    tested = found.where("not sure").select("sid", "head")
    blank = alike.where("size(needles) = 0")
    if not blank.isEmpty():  # values of white space alone
        pairs = s.select("sid", F.explode(_runs(F.col("s"), 2)).alias("pair"))
        tested = tested.unionByName(pairs.join(blank.select("head", F.substring("whole", 1, 2).alias("pair")), "pair").select("sid", "head"))
    tested = _joined(tested, alike, "head").join(s, "sid")
    holds_all = F.when(F.col("whole") != "", F.col("s").contains(F.col("whole"))).otherwise(F.forall("needles", lambda w: F.col("s").contains(w)))
    pairs = settled(found.where("sure").select("sid", "head").unionByName(tested.where(holds_all).select("sid", "head")))
    # the values that are alike follow only where one was found; each of their rows goes to as many tasks as the pairs need
    shares = settled(pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("tasks")))
    rest = members.join(_sent(alike), ["needles", "whole"]).where("vid <> head").select("head", "vid").join(_sent(shares), "head").select("head", "vid", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    dealt_out = pairs.join(_sent(shares), "head").select("sid", "head", F.pmod(F.xxhash64("sid"), F.col("tasks")).cast("int").alias("task"))
    more = dealt_out.join(rest.hint("merge"), ["head", "task"]).select("sid", "vid")
    return pairs.select("sid", F.col("head").alias("vid")).unionByName(more)


def attach(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence rows (rec_idx, source_id, url) of the records' urls whose canonical form is a known source's; others are dropped."""
    each = records.select("rec_idx", F.posexplode(F.array_distinct("source_urls")).alias("at", "url")).withColumn("url_hash", F.sha2(F.coalesce(urls.source_form(F.col("url")), F.lit("")), 256))
    return each.join(sources.select("source_id", "url_hash"), "url_hash").select("rec_idx", "at", "source_id", "url")


def sources_of_rows(evidence: DataFrame) -> DataFrame:
    """rec_idx, source_id, n_evidence, fields (distinct, in order of ``evidence_id``)."""
    first = evidence.where("field is not null").groupBy("rec_idx", "source_id", "field").agg(F.min("evidence_id").alias("at"))
    fields = first.groupBy("rec_idx", "source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "field"))), lambda x: x["field"]).alias("fields"))
    counts = evidence.groupBy("rec_idx", "source_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    return counts.join(fields, ["rec_idx", "source_id"], "left").select("rec_idx", "source_id", "n_evidence", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))


def field_citations(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rec_idx, field, evidence_id, verified: a field's own evidence, or all of the row's where it has none.

    ``rows``: rec_idx, field, value (a row for each field); ``evidence``: rec_idx, evidence_id, field, snippet.
    """
    evidence, rows = dealt(evidence.select("rec_idx", "evidence_id", "field", "snippet"), "rec_idx", rows)
    own = evidence.where("field is not null").select("rec_idx", "field").distinct().withColumn("_own", F.lit(True))
    rows = rows.join(own, ["rec_idx", "field"], "left")
    e = evidence.select("rec_idx", "evidence_id", F.col("field").alias("_field"), "snippet")
    cited = rows.join(e, "rec_idx").where(F.when(F.col("_own"), F.col("_field") == F.col("field")).otherwise(True))
    return cited.select("rec_idx", "field", "evidence_id", verifies(F.col("snippet"), F.col("value")).alias("verified"))


def field_view(citations: DataFrame) -> DataFrame:
    """rec_idx, field, n_sources, is_verified."""
    return citations.groupBy("rec_idx", "field").agg(F.count(F.lit(1)).alias("n_sources"), F.bool_or("verified").alias("is_verified"))


def explorer(records: DataFrame, citations: DataFrame, by_source: DataFrame) -> DataFrame:
    """One nested document for each row: its fields with citations, and its sources."""
    fields = citations.groupBy("rec_idx", "field").agg(F.sort_array(F.collect_list("evidence_id")).alias("citations"), F.bool_or("verified").alias("is_verified"))
    fields = fields.groupBy("rec_idx").agg(F.sort_array(F.collect_list(F.struct("field", "citations", "is_verified"))).alias("fields"))
    own = by_source.groupBy("rec_idx").agg(F.sort_array(F.collect_list(F.struct("source_id", "n_evidence", "fields"))).alias("sources"))
    return records.join(fields, "rec_idx", "left").join(own, "rec_idx", "left")


def insert(dataset: DataFrame, rows: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, evidence to append); raises if a row has no evidence."""
    bare = rows.join(evidence, "rec_idx", "left_anti")
    if not bare.isEmpty():
        raise ValueError("every row needs evidence")
    return rows.join(dataset, "rec_idx", "left_anti"), evidence.join(rows, "rec_idx", "left_semi")


def delete(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``children`` without those of the deleted parents."""
    return children.join(gone.select(key), key, "left_anti")
