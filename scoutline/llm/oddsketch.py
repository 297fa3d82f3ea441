"""Near-duplicate documents by MinHash bands, verified first by odd sketches and then on full shingle sets.

One pass over the texts gives each document a small row: the size of its shingle set, a 128-bit key of the set, one key per
band of MinHash values, and an odd sketch: every MinHash sample flips one bit of a bitmap, so the population count of the
XOR of two bitmaps grows with the samples in which the sets differ and estimates their similarity.

Documents with equal sets become one representative by aggregation, so exact copies cost nothing further. Representatives
that share a band key form a bucket. Inside a bucket nobody is compared with everybody: each bucket names a centre (a
different one in every band) and its members propose themselves to the centre. Proposals whose sketches rule a similarity
of 80 percent out are dropped; what the others connect is a family. The most similar proposals of each document are
confirmed on the texts, which joins most of a family. Whoever is then outside the largest component of its family meets the
whole family on full sets, tile by tile, and pairs that share a bucket but no family are compared by sketch and confirmed.
So no link is lost that shares a band. With 40 bands of 5 rows two documents at exactly 80 percent share none with
probability 1.3e-7.

Hot buckets: centres are found by partial aggregation, proposals are an equi-join that adaptive execution splits, texts
are grouped by (hub, chunk) with at most about `CHUNK` documents. Components are labels propagated in tables, with pointer
jumping; nothing but counts reaches the driver.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows without an id are
returned, linked with nothing, and kept. Rows with equal ids are one document (any of their texts can link it). Ties in
centres and labels go to smaller ids. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .common import free_name, only, text_of

BANDS, ROWS, SKETCH_BITS, SEED = 40, 5, 512, 20240
PERCENT = 80
#: A sketch estimate below this rules a pair out: 5 standard deviations of 200 samples under 0.8.
LEAST_ESTIMATE = 0.65
FIRST_PROPOSALS, CHUNK, BLOCK, GROUP_ROWS = 2, 64, 256, 4096
KNOWN_WORDS = 100_000

_rng = np.random.default_rng(SEED)
_A = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_C = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words: bytes.split() separates at \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str) -> set:
    w = words(text)
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {(w[0],)} if w else set()


class _Hash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = np.array([known[w] for w in words(text)], dtype=np.uint64)
    if len(h) < 2:
        return h
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return np.unique(x * np.uint64(0x94D049BB133111EB))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1 << 12):
        low = np.minimum(low, (_A * h[None, at:at + (1 << 12)] + _B).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(low[b * ROWS:(b + 1) * ROWS].tobytes(), seed=b) - 2**63 for b in range(BANDS)]


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples (number, value), as 64-bit words."""
    at = ((low ^ (low >> np.uint32(15))) * _C) >> np.uint32(32 - (SKETCH_BITS - 1).bit_length())
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def most_differing_bits(estimate: float = LEAST_ESTIMATE, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """The XOR population count up to which the estimate 1 + m / (4 k) ln(1 - 2 z / m) is at least `estimate`."""
    return int(bits / 2 * (1 - np.exp(4 * samples * (estimate - 1) / bits)))


FEATURES = "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>"


def features(docs: DataFrame) -> DataFrame:
    """One row per document: set size, 128-bit set key, band keys, odd sketch (the last four null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hash()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                h = shingle_hashes(text, known)
                if len(h):
                    low = minhashes(h)
                    key = xxhash.xxh3_128_digest(h.tobytes())
                    rows.append((doc_id, len(h), *np.frombuffer(key, "<i8").tolist(), band_keys(low), odd_sketch(low)))
                else:
                    rows.append((doc_id, 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=["id", "n", "k1", "k2", "bands", "sketch"]).astype({"id": "Int64", "k1": "Int64", "k2": "Int64"})

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("id"), text_of().alias("text")).mapInPandas(run, FEATURES)


def representatives(rows: DataFrame) -> DataFrame:
    """(id, n, bands, sketch) of the smallest id with each distinct set."""
    return (rows.filter(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "bands", "sketch")).alias("r"))
            .select("r.*"))


def _differing(a: str, b: str):
    words_ = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(words_, F.lit(0), lambda s, x: s + x)


def _similar_sizes(a: str, b: str):
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def proposals(reps: DataFrame, members: DataFrame) -> DataFrame:
    """(id, hub, differing) of bucket members and the centres of their buckets, where sizes and sketches allow a link. All
    buckets choose their centre by one order of the ids, so that a group of copies has the same few centres in all its buckets."""
    centres = cut_lineage(members.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("id").alias("order"), "id")).alias("c"))
                          .filter("m > 1").select("bucket", F.col("c.id").alias("hub")))
    pairs = cut_lineage(members.join(centres, "bucket").filter("id <> hub").select("id", "hub").distinct())
    side = reps.select("id", "n", "sketch")
    return cut_lineage(pairs.join(side, "id").join(side.toDF("hub", "hub_n", "hub_sketch"), "hub").filter(_similar_sizes("n", "hub_n"))
                       .select("id", "hub", _differing("sketch", "hub_sketch").alias("differing")).filter(F.col("differing") <= most_differing_bits()))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (id, hub) pairs whose full shingle sets are similar enough. texts: (id, text)."""

    def check(group: pd.DataFrame) -> pd.DataFrame:
        hubs = [shingle_set(t) for t in group.loc[group["is_hub"], "text"]]
        hub = int(group["hub"].iloc[0])
        out = []
        for doc_id, text in zip(*(group.loc[~group["is_hub"], c] for c in ("id", "text")), strict=True):
            s = shingle_set(text)
            both = max((len(s & h) / len(s | h) if 100 * len(s & h) >= PERCENT * len(s | h) else -1 for h in hubs), default=-1)
            if s and both >= 0:
                out.append((doc_id, hub))
        return pd.DataFrame(out, columns=["id", "hub"])

    sized = pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("m")), "hub").select(
        "id", "hub", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / CHUNK)).alias("chunk"))
    rows = (sized.select("id", "hub", "chunk", F.lit(False).alias("is_hub"))
            .union(sized.select(F.col("hub").alias("id"), "hub", "chunk", F.lit(True).alias("is_hub")).distinct()))
    return cut_lineage(rows.join(texts, "id").groupBy("hub", "chunk").applyInPandas(check, "id bigint, hub bigint"))


def _to_roots(forest: DataFrame) -> DataFrame:
    """(id, label) with every label replaced by the root above it: pointers are doubled until none moves."""
    while True:
        above = forest.select(F.col("id").alias("label"), F.col("label").alias("far"))
        forest = cut_lineage(forest.join(above, "label").select("id", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")))
        if forest.filter("moved").isEmpty():
            return forest.select("id", "label")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every linked id: the smallest id of its component. In each round every id hooks to its smallest neighbour;
    then edges are contracted: both ends become their roots, and loops and repeated edges go, so edges shrink from round to round."""
    def simple(edges: DataFrame) -> DataFrame:
        return cut_lineage(edges.select(F.least("id", "hub").alias("id"), F.greatest("id", "hub").alias("hub")).filter("id < hub").distinct())

    edges, labels = simple(links), None
    while labels is None or not edges.isEmpty():
        near = edges.union(edges.select("hub", "id")).groupBy("id").agg(F.min("hub").alias("near"))
        forest = _to_roots(cut_lineage(near.select("id", F.least("id", "near").alias("label"))))
        root = forest.select(F.col("id").alias("label"), F.col("label").alias("root"))
        labels = forest if labels is None else cut_lineage(labels.join(root, "label", "left").select("id", F.coalesce("root", "label").alias("label")))
        ends = edges.join(root.toDF("id", "low"), "id").join(root.toDF("hub", "high"), "hub")
        edges = simple(ends.select(F.col("low").alias("id"), F.col("high").alias("hub")))
    return labels


def _labelled(df: DataFrame, labels: DataFrame | None, name: str, out: str) -> DataFrame:
    """Adds the component label of an id column; an id without links is its own component."""
    if labels is None:
        return df.withColumn(out, F.col(name))
    return df.join(labels.toDF(name, "_label"), name, "left").withColumn(out, F.coalesce("_label", name)).drop("_label")


def open_pairs(reps: DataFrame, members: DataFrame, labels: DataFrame | None, families: DataFrame | None) -> DataFrame:
    """(id, hub) pairs that share a bucket but neither component nor family, and that the sketches allow. Of a bucket every
    member outside of its largest component meets the whole bucket, which is cut into blocks."""
    named = cut_lineage(_labelled(_labelled(members, labels, "id", "label"), families, "id", "family"))
    counts = named.groupBy("bucket", "family").agg(F.count("*").alias("m"))
    # a bucket of two has been settled by its centre, one of a single family by linked_in_families
    mixed = cut_lineage(counts.groupBy("bucket").agg(F.max(F.struct("m", "family")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("families"))
                        .filter("families > 1 AND m > 2").select("bucket", F.col("top.family").alias("top"), F.ceil(F.col("m") / BLOCK).alias("blocks"), "m"))
    groups = max(1, (mixed.agg(F.sum("m").alias("m")).first().m or 0) // GROUP_ROWS)
    within = named.join(mixed, "bucket").join(reps.select("id", "n", "sketch"), "id")
    whole = within.select("bucket", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "n", "label", "family", "sketch", F.lit(False).alias("asks"))
    asking = (within.filter("family <> top").select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
                                                    "id", "n", "label", "family", "sketch", F.lit(True).alias("asks")))
    limit = most_differing_bits()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """A group holds whole blocks of several buckets."""
        group = group.sort_values(["bucket", "block"], kind="stable")
        asks = group["asks"].to_numpy(bool)
        bucket, block, ids, n, label, family = (group[c].to_numpy(np.int64) for c in ("bucket", "block", "id", "n", "label", "family"))
        sketch = np.stack([np.asarray(s, np.int64) for s in group["sketch"]]).view(np.uint64)
        out: set[tuple[int, int]] = set()
        for start, end in _runs(bucket, block):
            asking_, there = start + np.nonzero(asks[start:end])[0], start + np.nonzero(~asks[start:end])[0]
            for i in asking_ if len(there) else ():
                differ = np.bitwise_count(sketch[there] ^ sketch[i]).sum(axis=1)
                fits = ((differ <= limit) & (label[there] != label[i]) & (family[there] != family[i])
                        & (100 * np.minimum(n[there], n[i]) >= PERCENT * np.maximum(n[there], n[i])))
                out.update((int(min(ids[i], j)), int(max(ids[i], j))) for j in ids[there[fits]])
        return pd.DataFrame(sorted(out), columns=["id", "hub"], dtype=np.int64)

    dealt = whole.union(asking).withColumn("group", F.pmod(F.xxhash64("bucket", "block"), F.lit(groups)))
    return cut_lineage(dealt.groupBy("group").applyInPandas(compare, "id bigint, hub bigint").distinct())


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal keys in sorted arrays."""
    changes = np.zeros(max(len(keys[0]) - 1, 0), dtype=bool)
    for k in keys:
        changes |= np.diff(k) != 0
    ends = np.append(np.nonzero(changes)[0] + 1, len(keys[0])).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 12) -> np.ndarray:
    """Sizes of the intersections of every set in a with every set in b, as products of 0/1 matrices, some shingles at a time."""
    every = a + b
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    values, column = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    shared = (np.bincount(column[row < len(a)], minlength=len(values)) > 0) & (np.bincount(column[row >= len(a)], minlength=len(values)) > 0)
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(every), min(width, int(shared.sum()) - start)), dtype=np.float32)
        m[row[s:e], column[s:e] - start] = 1
        out += m[:len(a)] @ m[len(a):].T
    return out.astype(np.int64)


def linked_in_families(families: DataFrame, labels: DataFrame | None, texts: DataFrame) -> DataFrame:
    """(id, hub) links between different components of one family, as many as join them.

    A family is what the proposals connect, confirmed or not. Every document outside the largest component of its family
    meets the whole family, in tiles of a block of one and a block of the other; full sets are intersected as matrices, and
    a tile reports one link per document and component it reaches, so a large family costs no pairs.
    """
    named = cut_lineage(_labelled(families.withColumnRenamed("label", "family"), labels, "id", "label"))
    counts = named.groupBy("family", "label").agg(F.count("*").alias("m"))
    mixed = cut_lineage(counts.groupBy("family").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("labels"))
                        .filter("labels > 1 AND m > 2").select("family", F.col("top.label").alias("top"), F.ceil(F.col("m") / BLOCK).alias("blocks"),
                                                               F.ceil((F.col("m") - F.col("top.m")) / BLOCK).alias("cuts"),
                                                               "m", (F.col("m") - F.col("top.m")).alias("outside")))
    groups = max(1, (mixed.agg(F.sum(F.expr("m * cuts + outside * blocks")).alias("m")).first().m or 0) // BLOCK)
    within = named.join(mixed, "family")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    whole = within.select("family", own("blocks").alias("block"), every("cuts").alias("cut"), "id", "label", F.lit(False).alias("asks"))
    asking = within.filter("label <> top").select("family", every("blocks").alias("block"), own("cuts").alias("cut"), "id", "label", F.lit(True).alias("asks"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """A group holds whole tiles of several families."""
        group = group.sort_values(["family", "block", "cut"], kind="stable")
        known, out = _Hash(), set()
        asks, text = group["asks"].to_numpy(bool), group["text"].tolist()
        family, block, cut, ids, label = (group[c].to_numpy(np.int64) for c in ("family", "block", "cut", "id", "label"))
        for start, end in _runs(family, block, cut):
            a, b = start + np.nonzero(asks[start:end])[0], start + np.nonzero(~asks[start:end])[0]
            if not len(a) or not len(b):
                continue
            left, right = [shingle_hashes(text[i], known) for i in a], [shingle_hashes(text[j], known) for j in b]
            both = intersections(left, right)
            union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
            for i, j in zip(*np.nonzero((100 * both >= PERCENT * union) & (label[a][:, None] != label[b][None, :])), strict=True):
                out.add((int(ids[a[i]]), int(label[b[j]])))
        return pd.DataFrame(sorted(out), columns=["id", "hub"], dtype=np.int64)  # the label is an id of the component reached

    dealt = whole.union(asking).withColumn("group", F.pmod(F.xxhash64("family", "block", "cut"), F.lit(groups)))
    return cut_lineage(dealt.join(texts, "id").groupBy("group").applyInPandas(compare, "id bigint, hub bigint").distinct())


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): kept is the smallest id of each component."""
    rows = cut_lineage(features(docs))
    reps = cut_lineage(representatives(rows))
    members = cut_lineage(reps.select("id", F.explode("bands").alias("bucket")))
    offered = proposals(reps, members)
    by_id = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("id"), text_of().alias("text"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        needed = cut_lineage(pairs.select("id").union(pairs.select("hub")).distinct())
        return cut_lineage(by_id.join(needed, "id", "left_semi"))

    links, labels, families = None, None, None

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        links = found if links is None else links.union(found)
        labels = components(links)

    if not offered.isEmpty():
        texts = texts_of(offered)
        families = components(offered)
        best = F.row_number().over(W.partitionBy("id").orderBy("differing", "hub"))  # at most one proposal per band
        add(confirm(offered.withColumn("turn", best).filter(F.col("turn") <= FIRST_PROPOSALS).select("id", "hub"), texts))
        add(linked_in_families(families, labels, texts))
    left = open_pairs(reps, members, labels, families)
    if not left.isEmpty():
        add(confirm(left, texts_of(left)))
    first = rows.filter(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    named = cut_lineage(_labelled(first, labels, "rep", "component"))
    out = rows.join(named, ["k1", "k2"], "left")
    return _whole_ids(out.select("id", "n", F.coalesce("component", "id").alias("component")))


def _whole_ids(out: DataFrame) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that are not the first of their component; all columns stay."""
    gone = cut_lineage(link(docs).filter("not kept").select("doc_id"))
    name = free_name(docs, "gone")
    return docs.join(gone.toDF(name), F.col("doc_id") == F.col(name), "left_anti")
