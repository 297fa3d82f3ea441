"""Quality rules as a ledger: every rule is evaluated once per document, policies are masks over the stored failure bits.

A rule is a condition on measurements; failing it sets the rule's bit. A policy version is a set of rules (a bit mask), so
a new policy, or the effect of leaving a rule out, is computed from the ledger without reading a text again.

Everything happens in one projection over the documents: no shuffle, so a hot source or a group of copies costs nothing
extra. Repeated word windows are found inside the row by sorting (hash, position) pairs, n log n in the words of a text.

Null or empty texts measure 0 everywhere and fail `few_words`. Null ids are carried. Repeated rows give repeated results.
Other columns are ignored. Empty tables give empty ledgers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, only, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3  # words


def _n(name: str) -> Column:
    return F.col(name)


def _rules() -> dict[str, tuple[int, Column]]:
    """Rule name -> (bit, failing condition on the measurements). Bits are permanent: a retired rule keeps its bit."""
    return {
        "few_words": (0, _n("n_words") < 50),
        "repeated_windows": (1, 100 * _n("n_repeat_words") > 50 * _n("n_words")),
        "symbols": (2, 10 * _n("n_symbols") > _n("n_words")),
        "duplicate_lines": (3, 100 * _n("n_dup_lines") > 50 * _n("n_lines")),
        "short_words": (4, _n("word_chars") < 2 * _n("n_words")),
        "long_words": (5, _n("word_chars") > 15 * _n("n_words")),
        "shouting": (6, 2 * _n("n_upper") > _n("word_chars")),
        "exclamations": (7, 10 * _n("n_exclamations") > _n("n_words")),
        "digits": (8, 2 * _n("n_digits") > _n("word_chars")),
    }


#: Policy version -> names of the rules it enforces. `base` is what every version contains.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting",
           "exclamations", "digits"),
}


def policy_mask(names: tuple[str, ...] | str) -> int:
    return sum(1 << _rules()[n][0] for n in (POLICIES[names] if isinstance(names, str) else names))


def _repeat_words(words: Column) -> Column:
    """Words inside a window of 3 words that occurs twice or more in the text, each word once.

    Windows become (64-bit hash, position), so that one sort brings equal windows together; neighbours with equal hashes
    count if their words are equal.
    """

    def covered(starts: Column) -> Column:
        """Length of the union of [p, p + 3) over sorted starts."""
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)).cast("int"))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    def repeated(windows: Column, w: Column) -> Column:
        same = lambda x, y: reduce(lambda a, k: a & (F.get(w, x["at"] + k) == F.get(w, y["at"] + k)), range(WINDOW), x["hash"] == y["hash"])
        kept = F.filter(windows, lambda x, i: same(x, F.get(windows, i + 1)) | same(x, F.get(windows, i - 1)))
        return covered(F.sort_array(F.transform(kept, lambda x: x["at"])))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("hash"), i.alias("at")))
        return let(F.sort_array(windows), lambda p: repeated(p, w))

    return let(words, lambda w: F.when(F.size(w) > WINDOW, of(w)).otherwise(F.lit(0).cast("bigint")))


def _without(text: Column, chars: str) -> Column:
    """How many code points of the text match the character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("bigint")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements the rules look at."""
    text = F.col("t")
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
                lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return (only(docs, "doc_id", "text").select("doc_id", text_of().alias("t"))
            .select("doc_id",
                    F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint").alias("n_words"),
                    F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("bigint").alias("word_chars"),
                    _without(text, SYMBOLS).alias("n_symbols"),
                    _without(text, "[A-Z]").alias("n_upper"),
                    _without(text, "!").alias("n_exclamations"),
                    _without(text, "[0-9]").alias("n_digits"),
                    lines.alias("l"),
                    _repeat_words(words_of(text)).alias("n_repeat_words"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_exclamations", "n_digits",
                    F.col("l.n").cast("bigint").alias("n_lines"), F.col("l.dup").cast("bigint").alias("n_dup_lines"),
                    "n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with `failed`, a BIGINT holding one bit per rule that the document fails."""
    bits = [F.when(condition, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint") for bit, condition in _rules().values()]
    return measure(docs).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(failed: Column, policy: tuple[str, ...] | str) -> Column:
    return failed.bitwiseAND(F.lit(policy_mask(policy)).cast("bigint")) == 0


def apply_policy(book: DataFrame, policy: tuple[str, ...] | str) -> DataFrame:
    """Adds `kept`: whether the document fails no rule of the policy."""
    return book.withColumn("kept", passes(F.col("failed"), policy))


def ablation(book: DataFrame, policy: tuple[str, ...] | str) -> DataFrame:
    """(rule, rejected_by_policy, freed_without, rejected_alone): what each rule of a policy contributes.

    Documents are first counted by failure pattern (at most 2 to the number of rules), and all else is bit arithmetic on
    those patterns. `freed_without`: documents that pass once the rule is left out. `rejected_alone`: documents the rule
    would reject as the only one.
    """
    mask = policy_mask(policy)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << _rules()[n][0]).cast("bigint").alias("bit")) for n in names])
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return (patterns.select("failed", "n", F.explode(rules).alias("r")).groupBy(F.col("r.rule").alias("rule"))
            .agg(total(F.col("failed") != 0).alias("rejected_by_policy"), total(F.col("failed") == F.col("r.bit")).alias("freed_without"),
                 total(F.col("failed").bitwiseAND(F.col("r.bit")) != 0).alias("rejected_alone")))


def keep_documents(docs: DataFrame, policy: tuple[str, ...] | str = "v2") -> DataFrame:
    """The documents that pass, with their own columns: measured and filtered in one scan, without a join.

    The measurements are taken on the row itself: the document travels as one struct beside the text being measured.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text").alias("text"))
    return apply_policy(ledger(held), policy).filter("kept").select("doc_id.*")
