"""Alignment of two tokenizers' tokens over the same texts, by anchors at white space.

Both tokenizers encode the whole text. Byte offsets of all tokens follow from their bytes; that these join to the text is
checked. Where a space-marked token of one and a space-marked token of the other start at the same offset, all tokens before
end there too, so the offset is a shared end: an anchor. Anchors cut a document into windows, pairs of tuples of token ids.
A window's alignment (the groups between its shared ends) depends on its ids alone: of the windows with equal id tuples in a
slice of texts one is kept, and these are aligned side by side. A worker remembers the ids of words that stood between single spaces.

The corpus-wide part counts, for each pair of ids, the documents that hold it linked. Documents keep their distinct pairs
with their numbers of links; pairs are counted with map-side combining and join back to the documents' pairs, as a broadcast
or a shuffle as Spark sees fit (it splits a pair that very many documents have), and sums return per row.

Documents whose text is null or empty, or whose tokens do not join to the text, have no tokens: zeros and an empty list of
groups. Texts are taken whole. Repeated rows count as documents of their own, null ids are carried, further columns are left
out, an empty table gives an empty result. A group without further shared ends is kept as it is, however long; its links are
counted from its distinct ids, never listed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import cut_lineage
from .common import only
from .packing import Encoder, default_tokenizer
from .piecemodel import MARK, PROBE, default_model, slices

# What a worker remembers (the ids of windows of one word), and the longest word among it: bounds on memory, not on the result.
KNOWN_WINDOWS, WORD_CHARS = 300_000, 48
PAIR = 1 << 32  # a pair of ids as one number: left * PAIR + right


class ByteTokens(Encoder):
    """Byte-level BPE: ids of a space and a text, and the bytes of every id. Special tokens in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.by_words = self.ids != self.whole_ids  # PATTERN is known to cut before each space
        self.added = []
        model = self.tokenizer.get_vocab(with_added_tokens=False)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        as_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        self.raw = [b""] * (max(model.values()) + 1)
        for token, i in model.items():
            if all(c in as_byte for c in token):
                self.raw[i] = bytes(as_byte[c] for c in token)

    @functools.cached_property
    def tokenizer(self):
        t = super().tokenizer
        t.encode_special_tokens = True
        return t

    def spaced(self, text: str) -> list[int]:
        return self.ids(" " + text)

    def words(self, words: list[str]) -> list[list[int]]:
        return list(map(self.spaced, words))


class PieceTokens:
    """Ids of a text under a piece model, which puts a space before it, and the bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids, every = model.encode, [model.id_to_piece(i) for i in range(model.get_piece_size())]
        # If so, a text has the ids of its words: no piece has a space behind another character, and no character is changed.
        self.by_words = model.normalize(PROBE) == (MARK + PROBE).replace(" ", MARK) and not any(MARK in p.lstrip(MARK) for p in every)
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode()
                    for i, p in enumerate(every)]

    def words(self, words: list[str]) -> list[list[int]]:
        return self.ids(words, num_threads=1)


class Side:
    """What the alignment needs of one tokenizer's ids: their bytes, lengths, whether they start with a space, and their decimal
    text, followed by what separates ids of a group, and by what ends this side of a group."""

    def __init__(self, raw: list[bytes], end: str):
        self.raw = raw
        self.length = np.array([len(r) for r in raw])
        self.marked = np.array([r.startswith(b" ") for r in raw])
        self.inner = np.array([f"{i}," for i in range(len(raw))], dtype=object)
        self.last = np.array([f"{i}{end}" for i in range(len(raw))], dtype=object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


class Windows(NamedTuple):
    """Many alignments: `pairs` and `times` of all windows stand one window's behind the other's, n_pairs of each."""

    text: list[str]  # the groups of each window, each with a ; behind it
    groups: np.ndarray
    links: np.ndarray
    n_pairs: np.ndarray
    pairs: np.ndarray  # left * PAIR + right
    times: np.ndarray  # links of each pair


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run behind the other: starts[0], starts[0] + 1, ..., starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _numbers(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the distinct ids of each group, by group."""
    keys, times = np.unique(groups * PAIR + ids, return_counts=True)
    return keys // PAIR, keys % PAIR, times


def align_windows(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, left: Side, right: Side) -> Windows:
    """Windows one behind the other, of n_a and n_b ids; both sides of a window cover the same bytes. A group ends where tokens
    of both end. All windows are aligned side by side."""
    end_a, end_b = np.cumsum(left.length[a]), np.cumsum(right.length[b])
    ends = np.zeros(end_a[-1] + 1, dtype="i1")
    ends[end_a] = 1
    ends[end_b] += 2
    last_a, last_b = ends[end_a] == 3, ends[end_b] == 3
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)

    text = np.empty(len(a) + len(b), dtype=object)  # a group's ids of a, then those of b
    text[np.arange(len(a)) + (to_b - in_b)[group_a]] = np.where(last_a, left.last[a], left.inner[a])
    text[np.arange(len(b)) + to_a[group_b]] = np.where(last_b, right.last[b], right.inner[b])
    text = text.tolist()

    (of_a, ids_a, times_a), (of_b, ids_b, times_b) = _numbers(group_a, a), _numbers(group_b, b)
    distinct_b = np.bincount(of_b, minlength=len(in_b))
    partners = distinct_b[of_a]  # each id of a meets the distinct ids of b in its group
    meets = spread((np.cumsum(distinct_b) - distinct_b)[of_a], partners)
    pairs, times = np.repeat(ids_a, partners) * PAIR + ids_b[meets], np.repeat(times_a, partners) * times_b[meets]

    groups = group_a[np.cumsum(n_a) - 1] + 1  # groups up to the end of each window; likewise links and pairs
    links, n_pairs = np.cumsum(in_a * in_b)[groups - 1], np.cumsum(np.bincount(of_a, weights=partners).astype("i8"))[groups - 1]
    cuts = np.cumsum(n_a + n_b).tolist()
    texts = ["".join(text[i:j]) for i, j in zip([0, *cuts], cuts)]
    return Windows(texts, *[np.diff(x, prepend=0) for x in (groups, links, n_pairs)], pairs, times)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype="u8"))


def equal_windows(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one window of each kind, the kind of each window). Windows are of one kind if their ids are equal: hashes say which may
    be, then the ids themselves are compared; those of equal hash but other ids become kinds of their own."""
    place_a, place_b = spread(np.zeros_like(n_a), n_a), spread(np.zeros_like(n_b), n_b)
    code = np.add.reduceat((a.astype("u8") + 1) * _powers(0x9E3779B97F4A7C15, n_a.max())[place_a], at_a)
    code ^= np.add.reduceat((b.astype("u8") + 1) * _powers(0xD1B54A32D192ED03, n_b.max())[place_b], at_b)
    _, one, kind = np.unique(code, return_index=True, return_inverse=True)
    like = one[kind]
    same = (n_a == n_a[like]) & (n_b == n_b[like])
    for ids, at, n, place in ((a, at_a, n_a, place_a), (b, at_b, n_b, place_b)):
        other = ids[np.minimum(np.repeat(at[like], n) + place, len(ids) - 1)]
        same &= np.logical_and.reduceat(ids == other, at)
    odd = np.flatnonzero(~same)
    kind[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), kind


class Aligner:
    """Both tokenizers and the remembered words of one Python worker."""

    def __init__(self, tokenizer: str, model: str):
        self.a, self.b = ByteTokens(tokenizer), PieceTokens(model)
        self.left, self.right = Side(self.a.raw, "|"), Side(self.b.raw, ";")
        self.by_words = self.a.by_words and self.b.by_words
        self.place: dict[str, int] = {}  # word -> its number, or -1: a text with this word is encoded whole
        self.ids_a, self.ids_b, self.size_a, self.size_b = [np.zeros(0, "i8")] * 4  # ids of the words, one word's behind the other's

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both sides; none for a text that is empty or differs from what the ids join to."""
        if text:
            one, two, whole = self.a.spaced(text), self.b.ids(text), b" " + text.encode()
            if self.left.joined(one) == whole and self.right.joined(two) == whole:
                return one, two
        return [], []

    def _learn(self, words: set[str]) -> None:
        """Remembers the ids of words, each with a space before it, for which both sides join to just that."""
        new = words.difference(self.place)
        if len(self.place) + len(new) > KNOWN_WINDOWS:
            self.place, new = {}, words
            self.ids_a, self.ids_b, self.size_a, self.size_b = [np.zeros(0, "i8")] * 4
        self.place.update(dict.fromkeys(new, -1))
        new = [w for w in new if 0 < len(w) < WORD_CHARS and not w[0].isspace() and not w[-1].isspace()]
        if not new:
            return
        text = " " + " ".join(new)
        flat_a, each_b = np.array(self.a.ids(text)), self.b.words(new)
        first_a = np.flatnonzero(self.left.marked[flat_a])
        flat_b, size_b = np.fromiter(chain.from_iterable(each_b), "i8"), np.array(list(map(len, each_b)))
        # A token that starts with a space starts a word, as no word has spaces inside.
        if len(first_a) == len(new) and self.left.joined(flat_a.tolist()) == self.right.joined(flat_b.tolist()) == text.encode():
            size_a = np.diff(first_a, append=len(flat_a))
        else:
            some = [(w, a, b) for w, a, b in zip(new, self.a.words(new), each_b) if self.left.joined(a) == self.right.joined(b) == b" " + w.encode()]
            new, each_a, each_b = [[x[k] for x in some] for k in range(3)]
            flat_a, flat_b = (np.fromiter(chain.from_iterable(x), "i8") for x in (each_a, each_b))
            size_a, size_b = (np.array(list(map(len, x)), dtype="i8") for x in (each_a, each_b))
        self.place.update(zip(new, range(len(self.size_a), len(self.size_a) + len(new))))
        self.ids_a, self.size_a = np.concatenate([self.ids_a, flat_a]), np.concatenate([self.size_a, size_a])
        self.ids_b, self.size_b = np.concatenate([self.ids_b, flat_b]), np.concatenate([self.size_b, size_b])

    def all_tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`tokens` of texts, one text's behind the other's, and how many each text has. Neither tokenizer joins what single spaces
        part, so words are encoded once and remembered. Texts in which a space touches other white space, or with a long word, are
        encoded whole."""
        words = [t.split(" ") if t and self.by_words else [] for t in texts]
        every = set().union(*words)
        self._learn(every)
        n_words = list(map(len, words))
        number = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), "i8", sum(n_words))
        ends = np.cumsum(n_words).tolist()
        parts = [number[i:j] for i, j in zip([0, *ends], ends)]
        whole = [k for k, (t, p) in enumerate(zip(texts, parts)) if t and (not len(p) or p.min() < 0)]
        ids = [self.tokens(texts[k]) for k in whole]
        for n, k in enumerate(whole):  # each as one more word
            parts[k] = np.array([len(self.size_a) + n])
        number, out = np.concatenate(parts), []
        for side, (flat, size) in enumerate(((self.ids_a, self.size_a), (self.ids_b, self.size_b))):
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable([x[side] for x in ids]), "i8")])
            size = np.concatenate([size, np.array([len(x[side]) for x in ids], dtype="i8")])
            out += [flat[spread((np.cumsum(size) - size)[number], size[number])], np.array([size[p].sum() for p in parts], dtype="i8")]
        for w in [w for w in every if len(w) >= WORD_CHARS]:
            del self.place[w]
        return tuple(out)

    def align(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Per text n_a, n_b, n_groups, n_links, groups, and the distinct pairs with their links, one text's behind the other's
        (n_pairs of them)."""
        a, sizes_a, b, sizes_b = self.all_tokens(texts)
        out = {"n_a": sizes_a, "n_b": sizes_b, "n_groups": np.zeros(len(texts), "i8"), "n_links": np.zeros(len(texts), "i8"),
               "groups": [""] * len(texts), "n_pairs": np.zeros(len(texts), "i8"), "pairs": np.zeros(0, "i8"), "links": np.zeros(0, "i8")}
        if not len(a):
            return out
        len_a, len_b = self.left.length[a], self.right.length[b]
        start_a, start_b = np.cumsum(len_a) - len_a, np.cumsum(len_b) - len_b
        full = np.flatnonzero(sizes_a)  # texts with tokens; each starts a window
        anchors = np.zeros(len_a.sum(), dtype="i1")
        anchors[start_a[self.left.marked[a]]] = 1
        anchors[start_b[self.right.marked[b]]] += 2
        anchors[start_a[(np.cumsum(sizes_a) - sizes_a)[full]]] = 3
        at_a, at_b = np.flatnonzero(anchors[start_a] == 3), np.flatnonzero(anchors[start_b] == 3)
        n_a, n_b = np.diff(at_a, append=len(a)), np.diff(at_b, append=len(b))
        one, kind = equal_windows(a, b, at_a, at_b, n_a, n_b)
        kinds = align_windows(a[spread(at_a[one], n_a[one])], b[spread(at_b[one], n_b[one])], n_a[one], n_b[one], self.left, self.right)

        text_of = np.repeat(np.arange(len(texts)), sizes_a)[at_a]  # of each window
        first = np.searchsorted(text_of, full)
        out["n_groups"][full], out["n_links"][full] = np.add.reduceat(kinds.groups[kind], first), np.add.reduceat(kinds.links[kind], first)
        groups = np.array(kinds.text, dtype=object)[kind].tolist()
        for t, i, j in zip(full.tolist(), first.tolist(), [*first[1:].tolist(), len(groups)]):
            out["groups"][t] = "".join(groups[i:j])[:-1]

        n_pairs = kinds.n_pairs[kind]
        held = spread((np.cumsum(kinds.n_pairs) - kinds.n_pairs)[kind], n_pairs)
        codes, links, owner = kinds.pairs[held], kinds.times[held], np.repeat(text_of, n_pairs)
        order = np.lexsort((codes, owner)) if len(texts) * len(self.left.raw) * len(self.right.raw) >= 1 << 63 else np.argsort(
            (owner * len(self.left.raw) + codes // PAIR) * len(self.right.raw) + codes % PAIR)
        codes, owner = codes[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])]))
        out["pairs"], out["links"] = codes[new], np.add.reduceat(links[order], new)
        out["n_pairs"] = np.bincount(owner[new], minlength=len(texts))
        return out


@functools.lru_cache(maxsize=1)
def aligner_of(tokenizer: str, model: str) -> Aligner:
    return Aligner(tokenizer, model)


def align(docs: DataFrame, tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """Per row of `docs`: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups (text: ids of a | ids of b; ...),
    pairs and links (distinct id pairs of the document, left * 2^32 + right, and how often each is linked)."""
    tokenizer, model = tokenizer or default_tokenizer(), model or default_model()
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                           T.StructField("groups", T.StringType()), T.StructField("pairs", longs), T.StructField("links", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(tokenizer, model)
        for batch in slices(batches, "text"):
            out = aligner.align(batch.column("text").to_pylist())
            ends = pa.array(np.cumsum([0, *out["n_pairs"]]).astype("int32"))
            numbers = [pa.array(out[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
            lists = [pa.ListArray.from_arrays(ends, pa.array(out[n], pa.int64())) for n in ("pairs", "links")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *numbers, pa.array(out["groups"], pa.string()), *lists], names=schema.names)

    source = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold the pair linked, and whether no pair of the same left id has more."""
    counts = cut_lineage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")))
    left = F.shiftright("pair", 32)
    most = counts.groupBy(left.alias("left")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("left", left).join(most, "left").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """`aligned`, a table, with n_best and count_sum of every row's links."""
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("n"))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    return aligned.drop("pairs", "links").join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_best", "count_sum")})


def report(docs: DataFrame, tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of the groups as text; '' without tokens)."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    aligned = cut_lineage(align(docs, tokenizer, model).select("row", *names, digest, "pairs", "links"))
    return with_counts(aligned, pair_counts(aligned)).select(*names, "n_best", "count_sum", "groups_sha256")
