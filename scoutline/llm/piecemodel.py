"""SentencePiece merge models: exact encoding by backtracking, and decoding.

The model merges, again and again, the neighbouring pair whose joined piece scores highest (leftmost first on equal
scores). The encoder gets the same pieces without replaying those merges over the text:

* An Aho-Corasick automaton over the vocabulary finds, in one pass, the lengths of all pieces that start at each character
  (a bit mask per character).
* From left to right the longest piece is taken whose place next to the piece before it is stable: the two, joined and
  merged anew, come out as they are. Merging restricted to two neighbours does what merging the whole text does there,
  until one merge crosses their border, so a sequence of pieces is the model's if and only if all neighbours are stable.
* Where no piece fits, the position is marked in a bitfield of failed positions and the piece before is replaced by its
  next shorter one. Every prefix of a text has one stable sequence, so a failed position fails whatever led to it, and no
  position is tried twice.

No piece has a space mark behind another character, or a Latin letter beside a character that is neither such a letter nor a mark, so
merges never cross such places. The chunks between them are encoded once and remembered (short ones, a bounded number of
them), those of many texts side by side. A model without these properties is encoded a whole text at a time. Characters outside the vocabulary become the bytes of their UTF-8
form. Models with user-defined or unused pieces, or with a normalizer that changes text, are refused.

Null and empty texts have no ids; ids null or empty decode to the empty text. Texts are taken whole, at any length, in
linear memory. Rows are carried as they are: repeated rows and null ids stay, further columns are left out, an empty table
gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array
from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only

MARK = "▁"  # stands for a space in pieces
CHUNKS = re.compile(f"(?:^|{MARK})({MARK}*[^{MARK}]*)").findall
LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]"  # Latin
PARTS = re.compile(f"{MARK}*{LETTERS}+|{MARK}*(?:(?!{LETTERS})[^{MARK}])+|{MARK}+").findall
# What a worker remembers, and how many texts it takes at once: bounds on memory, not on the result.
KNOWN_CHUNKS, KNOWN_PARTS, KNOWN_PAIRS, CHUNK_CHARS, TOGETHER, SLICE_CHARS = 250_000, 100_000, 300_000, 48, 20_000, 1_000_000
PAIR_BITS = 18  # pairs that are looked up side by side
SEPARATOR = "\0"
PROBE = " Ａ́  ﬁ "  # a text that every normalizer but the identity changes

codecs.register_error("each byte", lambda e: ("�", e.start + 1))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Recent:
    """What was found lately by key: at most `bound` values, and as many from before the memory was last full."""

    def __init__(self, bound: int):
        self.bound, self.now, self.older = bound, {}, {}

    def __len__(self) -> int:
        return len(self.now)

    def missing(self, keys: set) -> set:
        """The keys without a value. Values that were older are recent again."""
        unknown = keys.difference(self.now)
        again = {k for k in unknown if k in self.older}
        if again:
            of = self.older.__getitem__
            self.remember(dict(zip(again, map(of, again))))
            unknown -= again
        return unknown

    def remember(self, new: dict) -> None:
        if len(self.now) + len(new) > self.bound:
            self.now, self.older = dict(islice(new.items(), self.bound)), self.now
        else:
            self.now.update(new)

    def recall(self, keys: set[str], make: Callable[[set[str]], dict], longest: int) -> Mapping:
        """The values of all keys, and maybe of others: remembered, or else made. Keys of `longest` characters or more are not remembered."""
        now, older = self.now, self.older
        made = make(self.missing(keys))
        short = {k: v for k, v in made.items() if len(k) < longest}
        self.remember(short)
        if self.now is now and len(short) == len(made):
            return now
        every = ChainMap(made, self.now, now, older)  # the memory became full meanwhile, or there is more than it takes
        return {k: every[k] for k in keys}


class PieceModel:
    """Vocabulary of a model file, and the ids of the chunks met so far as little-endian 32-bit bytes."""

    def __init__(self, path: str, chunks: int | None = None):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != (MARK + PROBE).replace(" ", MARK):
            raise ValueError(f"{path} changes texts before it merges")
        every = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in every]
        self.unknown = {i for i in every if model.is_unknown(i)}
        self.control = {i for i in every if model.is_control(i)}
        self.byte_of = {i: int(pieces[i][3:5], 16) for i in every if model.is_byte(i)}
        special = self.unknown | self.control | set(self.byte_of)
        if any(model.is_unused(i) for i in every) or len(self.byte_of) != 256:
            raise ValueError(f"{path} has unused pieces or no piece for some byte")
        self.id_of = {pieces[i]: i for i in every if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = [i for i, _ in sorted(self.byte_of.items(), key=lambda e: e[1])]
        self.surface = [None if i in self.byte_of and self.byte_of[i] > 127 else chr(self.byte_of[i]) if i in self.byte_of else "" if i in self.control else " ⁇ " if i in self.unknown else p.replace(MARK, " ")
                        for i, p in enumerate(pieces)]
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        mixed = re.compile(f"[^{MARK}]{MARK}|{LETTERS}(?!{LETTERS}).|(?!{LETTERS})[^{MARK}]{LETTERS}", re.S)
        self.has_chunks = not any(map(mixed.search, self.id_of))
        self.pieces, self.sizes = pieces, [len(p) for p in pieces]
        self.size = np.array(self.sizes)
        self.alphabet = {p for p in self.id_of if len(p) == 1 and p != SEPARATOR}
        self.finder = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) > 1:
                self.finder.add_word(p, i)
        self.finder.make_automaton()
        self.single = np.full(max(map(ord, self.alphabet), default=0) + 1, -1, dtype="i8")  # code point -> id
        self.single[list(map(ord, self.alphabet))] = [self.id_of[c] for c in self.alphabet]
        if max(self.sizes[i] for i in self.id_of.values()) > 31 or any(SEPARATOR in p for p in self.id_of):
            raise ValueError(f"{path} has pieces too long for a bit mask of lengths, or pieces with a zero byte")
        self.stable: dict[int, bool] = {}  # id of a piece * 2^32 + id of the next one: do they fit?
        self.pair, self.pair_fits = np.full(1 << PAIR_BITS, -1 << 62, dtype="i8"), np.zeros(1 << PAIR_BITS, dtype=bool)  # some of `stable`, by hash
        self.known = Recent(chunks or KNOWN_CHUNKS)  # what follows the mark of a chunk -> ids
        self.parts = Recent(KNOWN_PARTS)  # parts of chunks, between letters and other characters -> ids

    def merged(self, text: str) -> list[str]:
        """The model's merges replayed over a text of a few characters."""
        parts, score = list(text), self.score.get
        while True:
            found = [(s, -i) for i in range(len(parts) - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
            if not found:
                return parts
            i = -max(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Do both come out again if they are joined and merged anew? `before` is empty for the first piece."""
        pair = [before, piece] if before else [piece]
        one, two = self.id_of.get(before, -2) if before else -1, self.id_of.get(piece)
        if one == -2 or two is None:
            return self.merged(before + piece) == pair
        key = one << 32 | two
        return self.stable[key] if key in self.stable else self._fits(key)

    def split(self, text: str) -> list[str]:
        """The pieces of a text whose spaces are marks already."""
        n = len(text)
        lengths = array("I", [2]) * n  # bit k: a piece of k characters starts here; one character is always possible
        for end, i in self.finder.iter(text):
            lengths[end + 1 - self.sizes[i]] |= 1 << self.sizes[i]
        lengths.append(0)
        failed = bytearray(n // 8 + 1)
        pieces: list[str] = []
        at, before, left = 0, "", lengths[0]
        while at < n:
            size = left.bit_length() - 1
            if size < 1:
                failed[at >> 3] |= 1 << (at & 7)
                size = len(pieces.pop())
                at -= size
                before, left = pieces[-1] if pieces else "", lengths[at] & ((1 << size) - 1)
                continue
            left ^= 1 << size
            end = at + size
            piece = text[at:end]
            if not failed[end >> 3] >> (end & 7) & 1 and self.fits(before, piece):
                pieces.append(piece)
                at, before, left = end, piece, lengths[end]
        return pieces

    def ids_of(self, text: str) -> bytes:
        pieces = self.split(text)
        ids = [self.id_of.get(p) for p in pieces]
        if None in ids:
            ids = [i for p, known in zip(pieces, ids) for i in ([known] if known is not None else [self.byte_id[b] for b in p.encode()])]
        return array("i", ids).tobytes()

    def _ids_of_parts(self, parts: set[str]) -> dict[str, bytes]:
        every, out = list(parts), {}
        for k in range(0, len(every), TOGETHER):
            out |= self._side_by_side(every[k:k + TOGETHER])
        return out

    def _ids_of_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks: their parts, each once, side by side."""
        split = {c: PARTS(MARK + c) for c in chunks if len(c) < CHUNK_CHARS} if self.has_chunks else {}
        of = self.parts.recall(set(chain.from_iterable(split.values())), self._ids_of_parts, CHUNK_CHARS).__getitem__
        out = {c: of(ps[0]) if len(ps) == 1 else b"".join(map(of, ps)) for c, ps in split.items()}
        for c in chunks - out.keys():
            out[c] = b"".join(map(self.ids_of, PARTS(MARK + c))) if self.has_chunks else self.ids_of(MARK + c)
        return out

    def _side_by_side(self, texts: list[str]) -> dict[str, bytes]:
        """Text -> ids. `split` for many texts at once: each step of the search is one step for all of them."""
        plain = [t for t in texts if not self.alphabet.issuperset(t)]
        out = {t: self.ids_of(t) for t in plain}  # with characters that are bytes, or the separator
        texts = [t for t in texts if t not in out]
        if not texts:
            return out
        joined = SEPARATOR.join(texts)
        found = np.fromiter(self.finder.iter(joined), dtype=[("end", "i8"), ("id", "i8")])
        size = self.size[found["id"]]
        alone = self.single[np.frombuffer(joined.encode("utf-32-le"), "<u4")]  # pieces of one character
        places = np.flatnonzero(alone >= 0)
        # Sorted by place, the longest piece of each place first: place, 31 - size and id in one number.
        order = np.sort(np.concatenate([(((found["end"] + 1 - size) << 5 | (31 - size)) << 32) | found["id"], (places << 5 | 30) << 32 | alone[places]]))
        ids, start = order & 0xFFFFFFFF, order >> 37
        ends = start + 31 - (order >> 32 & 31)
        sizes = np.array([len(t) for t in texts])
        at = np.cumsum(sizes + 1) - sizes - 1
        stop = at + sizes
        first = np.searchsorted(start, np.arange(stop[-1] + 2))  # place -> its longest piece
        failed = np.zeros(stop[-1] + 2, dtype=bool)
        stack = np.zeros((len(texts), sizes.max() + 1), dtype="i4")  # per text the pieces taken; column 0 is none
        taken = np.zeros(len(texts), dtype="i4")
        here, piece = at.copy(), first[at]
        open_ = np.arange(len(texts))
        none = len(ids)
        with_none = np.append(ids, -1)
        while len(open_):
            place, candidate = here[open_], piece[open_]
            dead = candidate >= first[place + 1]
            back = open_[dead]
            failed[place[dead]] = True
            last = stack[back, taken[back]]
            taken[back] -= 1
            before = stack[back, taken[back]]
            here[back] = np.where(taken[back] > 0, ends[np.where(taken[back] > 0, before, 0)], at[back])
            piece[back] = last + 1
            live, candidate = open_[~dead], candidate[~dead]
            before = with_none[np.where(taken[live] > 0, stack[live, taken[live]], none)]
            good = ~failed[ends[candidate]]
            good[good] = self._fit(before[good], ids[candidate[good]])
            piece[live] += 1
            forth, candidate = live[good], candidate[good]
            taken[forth] += 1
            stack[forth, taken[forth]] = candidate
            here[forth] = ends[candidate]
            piece[forth] = first[here[forth]]
            open_ = open_[here[open_] < stop[open_]]
        rows = np.repeat(np.arange(len(texts)), taken)
        ends_of = np.cumsum(taken)
        flat = ids[stack[rows, np.arange(len(rows)) - np.repeat(ends_of - taken, taken) + 1]].astype("<i4").tobytes()
        cuts = [0, *(4 * ends_of).tolist()]
        return out | {t: flat[i:j] for t, i, j in zip(texts, cuts, cuts[1:])}

    def _fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """`fits` for arrays of ids; -1 before the first piece."""
        keys = (before << 32) | after
        slots = ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype("i8")
        out = self.pair_fits[slots]
        other = np.flatnonzero(self.pair[slots] != keys)
        if len(other):
            known = self.stable
            if len(known) > KNOWN_PAIRS:
                known.clear()
            each, at = np.unique(keys[other], return_inverse=True)
            out[other] = np.array([known[k] if k in known else self._fits(k) for k in each.tolist()], dtype=bool)[at]
            _, one = np.unique(slots[other], return_index=True)
            put = other[one]
            self.pair[slots[put]], self.pair_fits[slots[put]] = keys[put], out[put]
        return out

    def _fits(self, key: int) -> bool:
        before, piece = key >> 32, self.pieces[key & 0xFFFFFFFF]
        pair = [piece] if before < 0 else [self.pieces[before], piece]
        known = self.stable[key] = self.merged("".join(pair)) == pair
        return known

    def chunks_of(self, text: str | None) -> list[str]:
        """What follows the mark of each chunk; the model puts a mark before the text."""
        if not text:
            return []
        rest = text.replace(" ", MARK)
        runs = rest.startswith(MARK) or rest.endswith(MARK) or 2 * MARK in rest
        return [rest] if not self.has_chunks else CHUNKS(rest) if runs else rest.split(MARK)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit bytes."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        chunks = list(map(self.chunks_of, texts))
        of = self.known.recall(set().union(*chunks), self._ids_of_chunks, CHUNK_CHARS).__getitem__
        return [b"".join(map(of, c)) for c in chunks]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes in a row are read as UTF-8 (each byte that is none becomes U+FFFD), and of a space that
        starts the first piece, one is the model's own."""
        parts = list(map(self.surface.__getitem__, ids))
        k = next((k for k, i in enumerate(ids) if i not in self.control), None)
        own = k is not None and self.raw[ids[k]].startswith(b" ") and ids[k] not in self.byte_of and ids[k] not in self.unknown
        try:
            text = "".join(parts)
        except TypeError:  # there are bytes among them
            out, run = [], bytearray()
            for i, part in zip(ids, parts):
                if part is None:
                    run.append(self.byte_of[i])
                elif run:
                    out += [run.decode("utf-8", "each byte"), part]
                    run.clear()
                else:
                    out.append(part)
            text = "".join([*out, run.decode("utf-8", "each byte")])
        return text[1:] if own else text


@functools.lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """One model, and one memory of chunks, per Python worker."""
    return PieceModel(path)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts reach about `SLICE_CHARS` bytes, one text at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()) // SLICE_CHARS
        cuts = [0, *(np.nonzero(np.diff(size))[0] + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                yield batch.slice(i, j - i)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, without begin or end ids."""
    path = model or default_model()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(path)
        for batch in slices(batches, "text"):
            rows = pieces.encode_all(batch.column("text").to_pylist())
            ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """`encoded` with the `text` of its ids."""
    path = model or default_model()
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(path)
        for batch in batches:
            column = batch.column("ids")
            texts = [pieces.decode(column[k].values.to_numpy().tolist() if column[k].is_valid else []) for k in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def report(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents encoded and decoded."""
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
