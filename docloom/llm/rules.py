"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long whose bit i is
set where rule i fails. Versioned policies are masks over these bits, so that a new policy, or an ablation of
an old one, reads the ledger and never the texts.

Edge cases: a null or empty text has no words and fails ``few_words``; ratios of nothing are 0; repeated rows
each get a ledger row; an empty table gives an empty ledger; input columns named like a ledger column are
replaced by it, others can be carried by ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds; its bit is its place in the list of rules."""

    name: str
    fails: str


#: Order fixes the bits: append only. Whole-number comparisons, so that every engine agrees.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 5 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("no_letters", "10 * n_letters < 5 * word_chars"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {r.name: 1 << i for i, r in enumerate(rules)}
        return sum(bits[name] for name in self.rules)


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}
CURRENT = "v2"


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Adds the measurements; the arrays are columns of their own so that each is made once."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(t, " \t\n\x0b\f\r", "")
    df = (
        df.withColumn("_words", F.filter(F.split(t, SPACE), lambda w: w != ""))
        .withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != ""))
        .withColumn("word_chars", F.length(plain).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_letters", F.length(F.regexp_replace(t, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("long"))
    )
    n = F.size("_words")
    windows = F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn("_sorted", F.sort_array(windows))
    # windows that stand next to an equal one in order of hash, back in order of place
    twice = F.filter(
        "_sorted", lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))
    )
    df = df.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("_twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_twice", i + 1) - p, F.lit(3))))
    return (
        df.withColumn("n_words", n.cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))
    )


def ledger(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each document: ``keep``, the measurements and ``bits``."""
    df = df.select(F.col(text).alias("_text"), *[F.col(c) for c in keep if c not in MEASURES and c != "bits"])
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)), F.lit(0).cast("long"))
    book = _measured(df, "_text").withColumn("bits", bits).drop("_text", "_words", "_lines", "_sorted", "_twice")
    # A generator of one row: filters above it cannot be moved below, where they would put the array expressions
    # into each other and evaluate them once for every word.
    return book.select(F.explode(F.array(F.struct(*book.columns))).alias("_book")).select("_book.*")


def failed(bits: Column, names: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(Policy("", tuple(names)).mask(rules)).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy = POLICIES[CURRENT], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger plus policy (its version) and kept."""
    return book.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~failed(F.col("bits"), policy.rules, rules))


def ablations(book: DataFrame, policy: Policy = POLICIES[CURRENT], rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger is first counted by bit pattern, at most two to the number of rules.
    """
    mask = policy.mask(rules)
    patterns = book.groupBy(F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules]))
    rows = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    zero = F.lit(0).cast("long")
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(zero)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )


def filter_documents(df: DataFrame, policy: Policy = POLICIES[CURRENT], text: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with their own columns."""
    own = df.columns
    packed = df.select(F.col(text).alias("_text"), F.struct(*[F.col(c) for c in own]).alias("_row"))
    book = ledger(packed, ["_row"], "_text")
    return apply_policy(book, policy).filter("kept").select("_row.*")
