"""Featurisation: components to fixed-width numeric blocks.

Chemistry-library fingerprints and descriptors are replaced by string equivalents with the same contract: a
fixed-width block per component, equal components get equal blocks, blocks are joined in column order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import _c
from ..functions.session import cut_lineage

GOLDEN = 2654435761  # multiplicative hash constant, 2^32 / golden ratio
DENSE_BITS = 65536   # fingerprints up to this width are collected in a bitmap


# --- encode each distinct component once -----------------------------------------------------------

def distinct_components(df: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct component values over all columns, as `component`, with their 128-bit digests d1 and d2.

    Grouping is by digest, so a long text crosses the network once per task that has it, and never as a key.
    """
    one, two = _digest("component")
    return (df.select(F.explode(F.array_distinct(F.array(*cols))).alias("component")).where(F.col("component").isNotNull())
            .groupBy(one.alias("d1"), two.alias("d2")).agg(F.first("component").alias("component")))


def _digest(col: str) -> tuple[Column, Column]:
    return F.xxhash64(col), F.xxhash64(F.lit(1), col)


def encode_distinct(df: DataFrame, cols: list[str], encoder: Callable[[Column], Column]) -> DataFrame:
    """Run `encoder` once per distinct component and look the block up for every row, as `<col>_enc`.

    `encoder` is a column expression or a pandas UDF. The blocks are written out once, so no later filter or
    second column makes Spark encode again, and the joins see their true size: a small block table is broadcast,
    a large one is shuffled and its hot components are split by adaptive execution.
    """
    blocks = cut_lineage(distinct_components(df, cols).select("d1", "d2", encoder(F.col("component")).alias("block")))
    for col in cols:
        lookup = blocks.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("block").alias(f"{col}_enc"))
        one, two = _digest(col)
        df = df.join(lookup, (one == F.col("_d1")) & (two == F.col("_d2")) & F.col(col).isNotNull(), "left").drop("_d1", "_d2")
    return df


# --- one-hot ---------------------------------------------------------------------------------------

def _chars(col: Column | str) -> Column:
    text = _c(col)
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def char_vocab(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, ch, idx, n_chars, max_len) of each column, with characters numbered in their own order.

    A vocabulary holds at most the Unicode characters, whatever the number of rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in cols]))
    long = df.select(pairs.alias("p")).select("p.col", "p.text")
    lengths = long.groupBy("col").agg(F.max(F.length("text")).cast("bigint").alias("max_len"))
    chars = long.select("col", F.explode(F.array_distinct(_chars("text"))).alias("ch")).distinct()
    numbered = Window.partitionBy("col").orderBy("ch")
    return (chars.withColumn("idx", (F.row_number().over(numbered) - 1).cast("bigint"))
            .withColumn("n_chars", F.count("*").over(Window.partitionBy("col")))
            .join(lengths, "col"))


def vocab_index(vocab: DataFrame, cols: list[str]) -> dict[str, tuple[dict[str, int], int]]:
    """The vocabulary read back as {column: (char -> index, max length)}."""
    out: dict[str, tuple[dict[str, int], int]] = {c: ({}, 0) for c in cols}
    for row in vocab.where(F.col("col").isin(cols)).collect():
        index, _ = out[row["col"]]
        index[row["ch"]] = row["idx"]
        out[row["col"]] = (index, row["max_len"])
    return out


def one_hot(df: DataFrame, cols: list[str], vocab: DataFrame, out: str = "slots") -> DataFrame:
    """The set slots of the flattened position x character matrix, columns one after another.

    The block is kept sparse, as the ascending array of slots that hold a 1. A character outside the vocabulary gives a
    null slot. Characters are looked up by code point in one sorted array per column, a batch at a time.
    """
    index = vocab_index(vocab, cols)
    blocks, offset = [], 0
    for col in cols:
        chars, max_len = index[col]
        blocks.append(_slot_encoder(chars, offset)(F.col(col)))
        offset += max_len * len(chars)
    return df.withColumn(out, F.concat(*blocks))


def _slot_encoder(chars: dict[str, int], offset: int) -> Callable[[Column], Column]:
    pairs = sorted((ord(ch), i) for ch, i in chars.items())
    codes, numbers = np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def slots(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            at = np.minimum(np.searchsorted(codes, points), max(len(codes) - 1, 0))
            known = codes[at] == points if len(codes) else np.zeros(len(points), bool)
            slot = np.arange(len(points)) * len(codes) + (numbers[at] if len(codes) else 0) + offset
            out.append(slot if known.all() else [int(v) if k else None for v, k in zip(slot, known)])
        return pd.Series(out)

    return slots


def _slot_decoder(letters: list[str], first: int, end: int) -> Callable[[Column], Column]:
    """Up to the first position without a character."""
    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            local = np.sort(np.asarray([v for v in row if v is not None and first <= v < end], dtype=np.int64)) - first
            at, which = np.divmod(local, max(len(letters), 1))
            off = np.nonzero(at != np.arange(len(at)))[0]
            out.append("".join(letters[k] for k in which[:off[0] if len(off) else len(which)]))
        return pd.Series(out, dtype=object)

    return text


def one_hot_decode(df: DataFrame, cols: list[str], vocab: DataFrame, slots: str = "slots") -> DataFrame:
    """The inverse of `one_hot`: position by position, up to the first position without a character."""
    index = vocab_index(vocab, cols)
    offset, decoded = 0, {}
    for col in cols:
        chars, max_len = index[col]
        end = offset + max_len * len(chars)
        decoded[col] = _slot_decoder([ch for ch, _ in sorted(chars.items(), key=lambda kv: kv[1])], offset, end)(F.col(slots))
        offset = end
    return df.withColumns(decoded)


# --- fingerprints and descriptors ------------------------------------------------------------------

def fingerprint(text: Column | str, n_bits: int = 2048, n: int = 3) -> Column:
    """The set bits, ascending, of a binary fingerprint: every character n-gram hashes to one bit.

    Works on the code points of the whole text, a batch of texts at a time; a text shorter than n has no bits.
    """
    @F.pandas_udf("array<int>")
    def bits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.zeros(n_bits, dtype=bool) if n_bits <= DENSE_BITS else None
        for batch in texts:
            yield pd.Series([_set_bits(text, n_bits, n, seen) for text in batch], dtype=object)

    return bits(_c(text))


def _set_bits(text: str | None, n_bits: int, n: int, seen: np.ndarray | None) -> np.ndarray:
    """`seen` is a bitmap that is clear before and after; without one the bits are sorted."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(codes) < n:
        return np.zeros(0, dtype=np.int32)
    grams = len(codes) - n + 1
    key = codes[:grams]
    for j in range(1, n):
        key = (key * 31 + codes[j:j + grams]) % 1073741824
    bits = (key * GOLDEN % 4294967296 * n_bits >> 32).astype(np.int32)
    if seen is None:
        return np.unique(bits)
    seen[bits] = True
    found = np.flatnonzero(seen).astype(np.int32)
    seen[found] = False
    return found


def encode(df: DataFrame, cols: list[str], encoder: Callable[[Column], Column], distinct: bool = True) -> DataFrame:
    """`<col>_enc` for each column: once per distinct component, or in place for texts that hardly repeat.

    In place there is no lookup; distinct components pay when they are far fewer than the rows.
    """
    return encode_distinct(df, cols, encoder) if distinct else df.withColumns({f"{c}_enc": encoder(F.col(c)) for c in cols})


def hash_fingerprint(df: DataFrame, cols: list[str], n_bits: int = 2048, n: int = 3, out: str = "slots",
                     distinct: bool = True) -> DataFrame:
    """Fingerprints of several components side by side."""
    encoded = encode(df, cols, lambda c: fingerprint(c, n_bits, n), distinct)
    return assemble_slots(encoded, [(f"{c}_enc", n_bits) for c in cols], out).drop(*[f"{c}_enc" for c in cols])


def descriptors(text: Column | str) -> Column:
    """Numeric descriptors of a string: length, letters, digits, upper case, blanks, mean word length.

    An empty string gives zeros, and so does the mean word length of a text without words.
    """
    t = F.coalesce(_c(text), F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    words = kept("[^ ]+") + F.lit(1.0)
    block = F.array(F.length(t).cast("double"), kept("[^a-zA-Z]+"), kept("[^0-9]+"), kept("[^A-Z]+"), kept("[^ ]+"),
                    (F.length(t) - kept("[^ ]+")) / words)
    return F.when(F.length(t) > 0, F.transform(block, lambda x: F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0))))) \
        .otherwise(F.array_repeat(F.lit(0.0), 6))


def descriptor_block(df: DataFrame, cols: list[str], out: str = "features",
                     encoder: Callable[[Column], Column] = descriptors, distinct: bool = True) -> DataFrame:
    encoded = encode(df, cols, encoder, distinct)
    return assemble(encoded, [f"{c}_enc" for c in cols], out).drop(*[f"{c}_enc" for c in cols])


def minmax(df: DataFrame, col: str = "features") -> DataFrame:
    """Each slot scaled to 0..1 over all rows; a constant slot becomes 0. One pass, vector aggregates."""
    vec = array_to_vector(F.col(col))
    stats = df.agg(Summarizer.metrics("min", "max").summary(vec).alias("s"))
    ends = F.arrays_zip(vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))
    scaled = F.zip_with(col, "_ends", lambda x, e: F.when(
        e["hi"] > e["lo"], (x - e["lo"]) / (e["hi"] - e["lo"])).otherwise(0.0))
    return df.withColumn("_ends", stats.select(ends).scalar()).withColumn(col, scaled).drop("_ends")


# --- property lookup -------------------------------------------------------------------------------

def union_lookup(sources: list[DataFrame], key: str = "component", props: tuple[str, ...] = ("p", "b")) -> DataFrame:
    """One property table from several sheets: a later sheet wins, a sheet without a property gives 0."""
    tagged = []
    for number, sheet in enumerate(sources):
        have = [F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) if p in sheet.columns
                else F.lit(0.0).alias(p) for p in props]
        tagged.append(sheet.select(key, *have, F.lit(number).alias("_no")))
    stacked = reduce(DataFrame.unionByName, tagged)
    return stacked.groupBy(key).agg(*[F.max_by(p, "_no").alias(p) for p in props])


def property_lookup(df: DataFrame, cols: list[str], lookup: DataFrame, key: str = "component",
                    props: tuple[str, ...] = ("p", "b"), out: str = "features") -> DataFrame:
    """Properties of each component by exact string, 0 when absent, interleaved [p_0, b_0, p_1, b_1, ...]."""
    for i, col in enumerate(cols):
        mine = lookup.select(F.col(key).alias(f"_k{i}"), *[F.col(p).alias(f"_{p}{i}") for p in props])
        df = df.join(mine, F.col(col) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    names = [f"_{p}{i}" for i in range(len(cols)) for p in props]
    return df.withColumn(out, F.array(*[F.coalesce(n, F.lit(0.0)) for n in names])).drop(*names)


# --- assembling ------------------------------------------------------------------------------------

def assemble(df: DataFrame, blocks: list[str], out: str = "features") -> DataFrame:
    """Dense blocks concatenated in order."""
    return df.withColumn(out, F.concat(*blocks))


def assemble_slots(df: DataFrame, blocks: list[tuple[str, int]], out: str = "slots") -> DataFrame:
    """Sparse blocks (slot array, width) concatenated in order: each block is shifted past the ones before it."""
    parts, offset = [], 0
    for col, width in blocks:
        parts.append(_shifted(F.coalesce(F.col(col), F.array().cast("array<int>")), offset))
        offset += width
    return df.withColumn(out, F.concat(*parts))


def _shifted(slots: Column, offset: int) -> Column:
    return F.transform(slots, lambda s: (s + offset).cast("int"))


def slots_to_dense(slots: Column | str, width: int) -> Column:
    """A sparse block as 0/1 doubles, for the operators that need dense rows."""

    @F.pandas_udf("array<double>")
    def scatter(rows: pd.Series) -> pd.Series:
        dense = np.zeros((len(rows), width))
        lengths = [len(r) for r in rows]
        if sum(lengths):
            dense[np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows.to_list())] = 1.0
        return pd.Series(list(dense))

    return scatter(_c(slots))


def slots_to_vector(df: DataFrame, slots: str, width: int, out: str) -> DataFrame:
    """A sparse block as an MLlib sparse vector: each slot is a word of a vocabulary that is just the numbers."""
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(width)], inputCol="_words", outputCol=out)
    words = df.withColumn("_words", F.col(slots).cast("array<string>"))
    return model.setBinary(True).transform(words).drop("_words")


def align_views(v0: DataFrame, v1: DataFrame) -> DataFrame:
    """Two views of the same rows side by side as x0, x1 with one label; a row in only one view is an error."""
    lone = lambda name: F.raise_error(F.lit(f"a row is missing from {name}"))
    left = v0.select("row_id", F.col("features").alias("x0"), "y")
    right = v1.select("row_id", F.col("features").alias("x1"))
    return (left.join(right, "row_id", "full_outer")
            .select("row_id", F.coalesce("x0", lone("the first view")).alias("x0"),
                    F.coalesce("x1", lone("the second view")).alias("x1"), "y"))


def binarize(col: Column | str, threshold: float) -> Column:
    """0 up to and including the threshold, else 1."""
    return F.when(_c(col) <= threshold, 0).otherwise(1)
