"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once; a document's ledger row holds what was measured
and one bit for each rule that it fails.  Policies are named, versioned sets
of rules and are applied to the bits, so a policy can change without reading
a text again, and ablations are bitwise aggregates over the ledger.

No step shuffles: words, windows and lines of one document are arrays in its
row.  Repeated windows are found by sorting (hash, place) pairs.

Defined results: a null text has no words; an empty text neither; every row
gives a row, repeated ids included; other columns pass through, and columns
with the name of a ledger column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmap.llm.common import SPACE

SYMBOLS = "#*$%&|<>"

#: Bits of the ledger. Fixed once published: a rule that changes gets a new bit.
RULES: dict[str, int] = {
    "few_words": 0,
    "repeated_windows": 1,
    "symbols": 2,
    "repeated_lines": 3,
    "word_length": 4,
    "capitals": 5,
    "long_word": 6,
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "longest_word")


@dataclass(frozen=True)
class Thresholds:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 30
    max_dup_line_percent: int = 60
    min_mean_word: float = 2.0
    max_mean_word: float = 12.0
    max_capital_percent: int = 40
    max_word: int = 1000


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals"))
STRICT = Policy("strict", 1, tuple(RULES))
POLICIES = {(p.name, p.version): p for p in (BASE, DEFAULT, STRICT)}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words lie in a window of three that the text has twice or more."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        # a window adds its three words, less those that the next window has too
        end = F.size(p) - 1
        return F.aggregate(F.transform(p, lambda x, k: F.when(k < end, F.least(F.lit(3), F.get(p, k + 1) - x)).otherwise(F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), lambda s: _let(places(s), covered)))


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the measurements of MEASURES."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    by_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.aggregate(w, F.lit(0), lambda a, x: F.greatest(a, F.length(x))).cast("long").alias("longest_word"),
        ),
    )
    by_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (
        docs.drop(*MEASURES)
        .withColumn("__w", by_words)
        .withColumn("__l", by_lines)
        .withColumns({
            "n_words": F.col("__w.n_words"),
            "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.col("__l.n_lines"),
            "n_dup_lines": F.col("__l.n_dup_lines"),
            "n_repeat_words": F.col("__w.n_repeat_words"),
            "n_capitals": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
            "longest_word": F.col("__w.longest_word"),
        })
        .drop("__w", "__l")
    )


def ledger(docs: DataFrame, at: Thresholds | None = None, text_column: str = "text") -> DataFrame:
    """docs with measurements and ``failed_bits``."""
    at = at or Thresholds()
    c = F.col
    fails = {
        "few_words": c("n_words") < at.min_words,
        "repeated_windows": 100 * c("n_repeat_words") > at.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > at.max_symbol_percent * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > at.max_dup_line_percent * c("n_lines"),
        "word_length": (c("word_chars") < at.min_mean_word * c("n_words")) | (c("word_chars") > at.max_mean_word * c("n_words")),
        "capitals": 100 * c("n_capitals") > at.max_capital_percent * c("word_chars"),
        "long_word": c("longest_word") > at.max_word,
    }
    bits = F.lit(0).cast("long")
    for rule, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text_column).drop("failed_bits").withColumn("failed_bits", bits)


def passes(policy: Policy) -> Column:
    """Whether a ledger row fails none of a policy's rules."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that pass with it left out."""
    bits, mask = F.col("failed_bits"), policy.mask
    one = F.lit(1).cast("long")
    sums = [F.count(F.lit(1)).alias("n")]
    for r in policy.rules:
        b = 1 << RULES[r]
        sums += [
            F.sum(F.when(bits.bitwiseAND(F.lit(b).cast("long")) != 0, one).otherwise(0)).alias(f"fails_{r}"),
            F.sum(F.when(bits.bitwiseAND(F.lit(mask).cast("long")) == b, one).otherwise(0)).alias(f"only_{r}"),
            F.sum(F.when(bits.bitwiseAND(F.lit(mask & ~b).cast("long")) == 0, one).otherwise(0)).alias(f"without_{r}"),
        ]
    total = rows.agg(*sums)
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("n_fails"), F.col(f"only_{r}").alias("n_only"), F.col(f"without_{r}").alias("n_kept_without")) for r in policy.rules])
    return total.select("n", F.explode(table).alias("x")).select("x.rule", "n", *[F.coalesce(F.col(f"x.{k}"), F.lit(0)).alias(k) for k in ("n_fails", "n_only", "n_kept_without")])
