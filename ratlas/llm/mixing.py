"""Mixing sources to target weights, on built-in functions only.

Each document gets a hash-random key; inside a source, documents stand in the order of their keys. Ranges of keys are
summed first, then the running sum is taken inside each range, so that no source is ever sorted in one task. A source
is cut at its exact budget: whole epochs first, then the documents up to the place where the budget ends, the last of
them in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratlas.llm.common import SPACE_CLASS, Scratch, count_words, trimmed

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that one range of keys holds on average.
RANGE_ROWS = 4096


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, most: int = 2) -> DataFrame:
    """source, source_size (long) -> the same with weight and target (double).

    All targets together are share_percent of all sizes. A target stops at `most` times its source's size; what is
    left goes to the others by weight, until none is above. Sorted by the ratio of cap to weight, the capped sources
    come first, so one running sum finds the level at which the others are filled. One row a source; sizes of 0 get 0.
    If share_percent asks for more than `most` times everything, every source is at its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", pick.cast("long")).withColumn("__cap", F.col("source_size") * most)
    level = Window.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100)
    s = s.withColumn("__left", total - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
    s = s.withColumn("__w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("__level", F.col("__left") / F.col("__w"))
    # the level at the first source that stays below its cap holds for all after it
    s = s.withColumn("__at", F.when(F.col("__cap") > F.col("__level") * F.col("weight"), F.row_number().over(level)))
    s = s.withColumn("__fill", F.min_by("__level", "__at").over(everything))
    goal = F.when(F.col("__fill").isNull() | (F.col("__cap") <= F.col("__fill") * F.col("weight")), F.col("__cap").cast("double"))
    return s.select("source", "source_size", "weight", goal.otherwise(F.col("__fill") * F.col("weight")).alias("target"))


def random_key(seed: str, *columns: Column) -> Column:
    """A hash-random key as 32 hexadecimal digits, the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def cuts(sized: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, most: int = 2) -> DataFrame:
    """source, size, key -> per source: source_size, target, epochs, and where its last epoch ends: key, amount, unit.

    Documents whose key is below `key` take one epoch more, those above none; documents at `key` (one, unless ids
    repeat) hold `unit` words together and share `amount`. Equal keys are added up first, then ranges of keys, so
    neither a hot source nor a hot key meets in one task.
    """
    units = scratch.save(sized.groupBy("source", "key").agg(F.sum("size").alias("unit")), "units")
    n, ranges = units.count(), 1
    while ranges * RANGE_ROWS < n and ranges < 1 << 30:
        ranges *= 2
    place = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges, 32).cast("int")
    units = units.withColumn("range", place)
    sums = units.groupBy("source", "range").agg(F.sum("unit").alias("sum"))
    goals = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share_percent, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", whole).withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    # only the range in which a source's budget ends is sorted
    ends = starts.alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source AND s.start < g.rest AND g.rest <= s.start + s.sum"))
    ends = ends.select(F.col("s.source").alias("e_source"), F.col("s.range").alias("e_range"), (F.col("rest") - F.col("start")).alias("e_rest"))
    last = units.join(ends, F.expr("source <=> e_source AND range = e_range"))
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("held", F.coalesce(F.sum("unit").over(inside), F.lit(0))).where("held < e_rest AND e_rest <= held + unit")
    last = last.select(F.col("source").alias("l_source"), "key", (F.col("e_rest") - F.col("held")).alias("amount"), "unit")
    out = goals.join(last, F.expr("source <=> l_source"), "left").drop("l_source", "rest", "weight")
    out = scratch.save(out, "cuts")
    scratch.drop("units")
    return out


def taken(size: Column, key: Column) -> Column:
    """Words that the mix takes of a document, given its row of cuts()."""
    share = F.floor(size * F.col("cut_amount") / F.col("cut_unit"))
    extra = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), share).otherwise(F.lit(0))
    return (size * F.col("cut_epochs") + F.coalesce(extra, F.lit(0))).cast("long")


def _with_cuts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the cut of their source; null sources match each other."""
    names = {"source": "cut_source", "key": "cut_key", "amount": "cut_amount", "unit": "cut_unit", "epochs": "cut_epochs"}
    return rows.join(found.withColumnsRenamed(names), F.expr("__source <=> cut_source"), "left")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken.

    size counts words (null text: 0). taken counts words the mix takes, repeats included; over a source they add up to
    the whole part of its target. Rows with one key (repeated or null doc_ids) share what their key is given by size,
    rounded down. A null source is a source of its own. Empty tables give no rows. Reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), random_key(seed, F.col("doc_id")).alias("key")), "rows")
    found = cuts(rows, scratch, weights, share_percent, most)
    out = _with_cuts(rows.withColumn("__source", F.col("source")), found)
    return out.select("doc_id", "source", "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed documents, with the columns of docs: each as often as taken asks, the last copy cut to its words.

    Documents without words never appear: no budget is spent on them. n_chars, where docs has it, follows the text. The
    texts aren't shuffled: each document finds its place from its own key and the row of its source.
    """
    sized = docs.select("source", count_words(F.col("text")).alias("size"), random_key(seed, F.col("doc_id")).alias("key"))
    found = cuts(sized, Scratch(docs.sparkSession, "mix"), weights, share_percent, most)
    row = docs.select(F.struct("*").alias("__row"), F.col("source").alias("__source"), count_words(F.col("text")).alias("__size"), random_key(seed, F.col("doc_id")).alias("__key"))
    out = _with_cuts(row, found).withColumn("__taken", taken(F.col("__size"), F.col("__key"))).where("__taken > 0")
    out = out.withColumn("__copy", F.explode(F.expr("sequence(1, cast(ceil(__taken / __size) as int))")))
    left = F.least(F.col("__size"), F.col("__taken") - (F.col("__copy") - 1) * F.col("__size"))
    cut = F.array_join(F.slice(F.split(trimmed(F.col("__row.text")), SPACE_CLASS + "+"), F.lit(1), left.cast("int")), " ")
    out = out.withColumn("__text", F.when(left < F.col("__size"), cut).otherwise(F.col("__row.text")))
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
