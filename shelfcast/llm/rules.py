"""Quality rules as a ledger: every rule once per document, one failure bit each, policies applied afterwards."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import SPACES, WORD

WINDOW_WORDS = 5
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements. A null condition is no failure."""

    name: str
    fails: str


# The order fixes the bit of each rule: new rules go to the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("shouting", "2 * n_capitals > word_chars"),
    Rule("exclaiming", "10 * n_exclaim > n_words"),
)
BASE = ("few_words", "repeated_windows")
# Policies are versioned names for sets of rules; a ledger is written once and read under any of them.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "strict-1": (*BASE, "many_symbols", "repeated_lines", "long_words", "shouting", "exclaiming"),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in set(names))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it and wherever the
    optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more among ``words``."""
    size = F.size(words)
    starts = F.when(size >= WINDOW_WORDS, F.sequence(F.lit(0), size - WINDOW_WORDS)).otherwise(
        F.array().cast("array<int>"))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW_WORDS)]).alias("h"), i.alias("i"))))

    def places(w: Column) -> Column:
        equal = F.filter(w, lambda x, i: (x["h"] == F.get(w, i - 1)["h"]) | (x["h"] == F.get(w, i + 1)["h"]))
        return F.array_sort(F.transform(equal, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(WINDOW_WORDS)).otherwise(
            F.least(F.lit(WINDOW_WORDS), x - F.get(p, i - 1))).cast("bigint"))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, b: a + b)

    return _once(windows, lambda w: _once(places(w), covered))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements of each document, in one pass over the texts and without a shuffle.

    ``n_repeat_words`` counts the words covered by windows of five words that occur twice or more in the
    text. Windows are compared by 64-bit hashes: sorted together with their places, equal neighbours give
    the repeated places, and each adds at most the words that the place before it did not cover. The work
    is n log n in the words of one text. A null text has no words; all counts are then 0. Keys may be null
    or repeated: rows stay apart. Other columns are ignored.
    """
    words = F.filter(F.split(F.col("_text"), SPACES), lambda w: w != "")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(WORD))
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counted = base.select(
        "_key",
        _once(words, lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        _once(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("_l"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("_text", F.lit("!")).cast("bigint").alias("n_exclaim"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.length(F.regexp_replace("_text", SPACES, "")).cast("bigint").alias("word_chars"))
    return counted.select(
        F.col("_key").alias(key), "_w.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines",
        "_w.n_repeat_words", "n_exclaim", "n_capitals")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the measurements and ``failed``, one bit per rule."""
    failed = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, key, text).withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """Add the verdict of a policy to a ledger."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)


def ablation(rows: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that stay without it.

    The ledger is first counted by its masked bits, at most 2 ** rules combinations whatever its size.
    """
    mask = mask_of(POLICIES[policy], rules)
    combos = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit"))
                      for i, r in enumerate(rules) if r.name in POLICIES[policy]])
    each = combos.withColumn("r", F.explode(names)).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0))
        .alias("n_kept_without"))
