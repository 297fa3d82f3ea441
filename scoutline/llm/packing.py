"""Packing documents into fixed-length sequences: patterns of few documents, repeated as a non-negative least squares fit says.

Documents are tokenized and cut where they are (Arrow batches, no shuffle), giving one small row per piece. Piece lengths
are counted: a histogram of at most `max_tokens` entries, whatever the number of documents. From it the driver plans:
patterns of up to three lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by NNLS
(accelerated projected gradient), rounded, limited to what exists, and the residual lengths are packed best-fit into the
room that is left and into new sequences. The plan is a list of slots: ranks of pieces of one length -> sequence, offset.

Pieces get their rank among those of equal length from salted groups whose number grows with the table plus group offsets,
so a length that a third of all pieces have is spread over many tasks. A rank finds its slot by binary search in the plan.

Null or empty texts are documents of one token, the end mark. Null ids are carried; rows with equal ids are packed as
separate documents. Other columns are ignored. An empty table gives no pieces. Of a long document the first piece may be
shorter than the rest.
"""

from __future__ import annotations

import bisect
import functools
import json
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .common import only, text_of

MAX_TOKENS, END = 1024, 2
KNOWN_WORDS = 300_000  # words a worker remembers before it starts afresh: a bound on memory, not on the result
FIT_ROUNDS = 400
GROUP_ROWS = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE file, or None if its ids do not follow the order of its merges."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    as_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or made != sorted(made):
        return None
    return {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in as_byte for c in token)}


class _Spaced(Exception):
    """A piece between two spaces is empty, or begins or ends with other white space."""


class Encoder(dict):
    """Text -> ids as little-endian 32-bit bytes. Byte-level BPE never merges across the space that starts a word, so words
    are encoded once and remembered; a text in which a space touches other white space is encoded as a whole.

    The vocabulary file is that of `tokenizers`; where its ids are merge ranks, a faster encoder of the same ids reads it.
    A text that holds an added token of the file is encoded as a whole by `tokenizers`, which gives it the token's id.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.added = [t["content"] for t in json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens") or []]
        ranks = _ranks(path)
        if ranks is not None:
            import tiktoken

            special = {token: i for token, i in ranks.items() if token in {t.encode() for t in self.added}}
            self.ids = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t not in special}, special_tokens={}).encode_ordinary
        else:
            self.ids = self.whole_ids

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        ids = self.ids(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Spaced
        if len(self) >= KNOWN_WORDS:
            self.clear()
        ids = self[word] = self.encode(" " + word)
        return ids

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            ids = self.whole_ids(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *words = text.split(" ")
        if words and (not first or first[-1].isspace()):
            return self.encode(text)
        try:
            return self.encode(first) + b"".join([self[w] for w in words])
        except _Spaced:
            return self.encode(text)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder, and one memory of words, per Python worker."""
    return Encoder(path)


def cut(tokens: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than `max_tokens`."""
    head = tokens % max_tokens or max_tokens
    return [(0, head)] + [(s, max_tokens) for s in range(head, tokens, max_tokens)]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    mark = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = memoryview(encoder(text) + mark)
                for k, (start, length) in enumerate(cut(len(ids) // 4, max_tokens)):
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype("int32"),) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            yield out.astype({"doc_id": "Int64"})

    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return source.mapInPandas(run, PIECES + ", ids array<int>" * with_ids)


def _patterns(lengths: np.ndarray, max_tokens: int) -> np.ndarray:
    """Rows of up to three lengths (descending, 0 for none): each length alone, and each fitting pair with the largest third
    length that still fits."""
    have = np.zeros(max_tokens + 1, dtype=np.int64)
    have[lengths] = lengths
    floor = np.maximum.accumulate(have)  # largest length that exists, up to a room
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    fits = (a >= b) & (a + b <= max_tokens)
    a, b = a[fits], b[fits]
    c = floor[np.minimum(max_tokens - a - b, b)]
    single = np.stack([lengths, 0 * lengths, 0 * lengths], 1)
    return np.concatenate([single, np.stack([a, b, c], 1)])


def fit_counts(histogram: np.ndarray, patterns: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that bring A x near the histogram in the least squares sense.

    A has at most three ones per column and is never built: products are sums and look-ups by length.
    """
    size = len(histogram)
    used = patterns > 0
    flat, owner = patterns[used], np.nonzero(used)[0]
    forward = lambda x: np.bincount(flat, weights=x[owner], minlength=size)
    backward = lambda r: np.bincount(owner, weights=r[flat], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):  # largest eigenvalue, for the step
        v = backward(forward(v))
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - backward(forward(y) - histogram) / (1.02 * step))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences): every counted piece is in exactly one."""
    left = np.zeros(max_tokens + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    lengths = np.nonzero(left)[0]
    if len(lengths):
        patterns = _patterns(lengths, max_tokens)
        repeats = np.rint(fit_counts(left.astype(float), patterns)).astype(np.int64)
        # patterns that waste least come first, then those repeated most
        for k in np.lexsort((-repeats, max_tokens - patterns.sum(1))):
            if repeats[k] > 0 and patterns[k].sum() >= max_tokens - 8:
                content = tuple(int(v) for v in patterns[k] if v)
                n = min(int(repeats[k]), *(int(left[v]) // content.count(v) for v in content))
                if n > 0:
                    made.append((content, n))
                    for v in content:
                        left[v] -= n
    return _best_fit(made, left, max_tokens)


def _best_fit(made: list[tuple[tuple[int, ...], int]], left: np.ndarray, max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: pieces of a length go together into the groups of sequences with the least room."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_rooms: list[int] = []

    def put(content: tuple[int, ...], n: int) -> None:
        space = max_tokens - sum(content)
        if space not in room:
            room[space] = []
            bisect.insort(open_rooms, space)
        room[space].append((content, n))

    for content, n in made:
        put(content, n)
    for length in np.nonzero(left)[0][::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect.bisect_left(open_rooms, length)
            if at < len(open_rooms):
                space = open_rooms[at]
                content, m = room[space].pop()
                if not room[space]:
                    del room[space], open_rooms[at]
                take = min(m, n)
                put((*content, length), take)
                if m > take:
                    put(content, m - take)
                n -= take
            else:
                each = max_tokens // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                n = 0
    return [group for space in open_rooms for group in room[space]]


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Arrays by slot, sorted by (length, first rank): where the pieces of that length from that rank on go."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for content, n in groups:
        offset = 0
        for length in content:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, offset))
            next_rank[length] = rank + n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def ranked(cut_pieces: DataFrame, rows: int) -> DataFrame:
    """Adds `rank`, from 0 among the pieces of a length: position in a salted group plus the sizes of the groups before it."""
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, rows // GROUP_ROWS))))
    before = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
              .select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")))
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return (salted.withColumn("place", place).join(before, ["length", "salt"])
            .withColumn("rank", F.col("place") - 1 + F.col("before")).drop("salt", "place", "before"))


def assign(cut_pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces. `cut_pieces` is read twice, so it should be a table."""
    histogram = {r.length: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    table = slots(plan(histogram, max_tokens))
    keys = table["length"] * (1 << 44) + table["rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(keys, batch["length"].to_numpy(np.int64) * (1 << 44) + rank, side="right") - 1
            yield batch.assign(sequence_id=table["sequence"][at] + rank - table["rank"][at], offset=table["offset"][at])

    out = ranked(cut_pieces, sum(histogram.values()))
    names = [c for c in cut_pieces.columns]
    schema = ", ".join(f"{c} {t}" for c, t in cut_pieces.dtypes)
    return out.select(*names, "rank").mapInPandas(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    return assign(cut_lineage(pieces(docs, tokenizer or default_tokenizer(), max_tokens, end, with_ids)), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of a result packed with its ids: what a trainer reads, at most `max_tokens` ids a row."""
    return (packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids")))
