"""Quality rules as a bitmask ledger, on built-in functions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long with a bit for each
rule that the document fails. Policies are masks over those bits: applying another version, or asking what a rule
alone removes, reads the ledger and never the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratlas.llm.common import SPACE_CLASS, WORD_CLASS, trimmed

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """bit: its place in the ledger for all time; fails: a condition on the measurements."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any rule of the mask."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


#: Conditions in whole numbers, so that any engine decides alike.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "5 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "long_words", "word_chars > 12 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
)
BASE = Policy("base", ("too_few_words", "repeated_windows"))
POLICY = Policy("2024-1", tuple(r.name for r in RULES))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Null, empty and blank texts have no words and zeros everywhere. Columns of docs with these names are replaced.

    Repeated windows are found inside the row: each 3-word window becomes one long (as much of its hash as fits above its
    position in the low bits), and a primitive sort brings equal windows together. Windows with an equal neighbour are
    candidates; their words are then sorted and compared, so a chance agreement of hashes counts for nothing however
    long the text. No row is exploded, so nothing is shuffled and a text costs its length times its logarithm.
    """
    keep = [c for c in docs.columns if c not in {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"}]
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, trimmed(F.col(text)).alias("__t"))
    empty = F.expr("cast(array() as array<string>)")
    df = df.withColumn("__w", F.when(F.col("__t") == "", empty).otherwise(F.split("__t", SPACE_CLASS + "+")))
    df = df.withColumn("__l", F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD_CLASS)))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    # bits that hold any position of this text
    df = df.withColumn("__b", F.expr("coalesce(cast(length(bin(n_words)) as int), 1)"))
    df = df.withColumn(
        "__k",
        F.expr(
            "CASE WHEN n_words < 4 THEN cast(array() as array<bigint>) ELSE sort_array(transform(sequence(0, cast(n_words as int) - 3), "
            "i -> shiftleft(xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2)), __b) | cast(i as bigint))) END"
        ),
    )
    df = df.withColumn(
        "__c",
        F.expr(
            "transform(filter(__k, (x, j) -> shiftright(x, __b) = shiftright(get(__k, j - 1), __b) "
            "OR shiftright(x, __b) = shiftright(get(__k, j + 1), __b)), x -> x & (shiftleft(1L, __b) - 1))"
        ),
    )
    df = df.withColumn("__s", F.expr("sort_array(transform(__c, i -> struct(concat_ws(' ', get(__w, cast(i as int)), get(__w, cast(i as int) + 1), get(__w, cast(i as int) + 2)) as s, i as i)))"))
    df = df.withColumn("__p", F.expr("sort_array(transform(filter(__s, (x, j) -> x.s = get(__s, j - 1).s OR x.s = get(__s, j + 1).s), x -> x.i))"))
    covered = F.expr("CASE WHEN size(__p) = 0 THEN 0L ELSE aggregate(sequence(0, size(__p) - 1), 0L, (s, j) -> s + least(3L, coalesce(get(__p, j + 1) - get(__p, j), 3L))) END")
    return df.select(
        *keep,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs without new rows, with the measurements and fail_bits (long): bit r is set if rule r fails."""
    bits: Column = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measures(docs, text).withColumn("fail_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablation(book: DataFrame, policy: Policy = POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: n_failed, n_only (rejected by it alone) and n_kept_without it; n_kept under the policy.

    Documents are first counted by pattern of bits, at most two to the power of the rules in number; the rest is
    bitwise arithmetic over those counts. An empty ledger gives zeros.
    """
    mask, spark = policy.mask(rules), book.sparkSession
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = spark.createDataFrame([(r.name, 1 << r.bit) for r in rules if r.name in policy.rules], "rule string, bit long")
    joined = F.broadcast(each).join(counts, F.lit(True), "left")
    n = F.coalesce("n", F.lit(0))
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    return joined.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(F.col("bits").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("bit"))) == 0).alias("n_kept_without"),
        total(F.col("bits") == 0).alias("n_kept"),
    )


def keep_good(docs: DataFrame, policy: Policy = POLICY, text: str = "text") -> DataFrame:
    """The rows of docs that pass a policy, with the columns of docs.

    The condition reads the ledger through a generator of one row, below which the optimizer doesn't move it: moved, it
    would take the measurements anew for every rule that uses them.
    """
    book = ledger(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), text="__text")
    book = book.select("__row", F.explode(F.array("fail_bits")).alias("fail_bits"))
    return book.where(passes(policy)).select("__row.*")
