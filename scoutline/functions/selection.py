"""Exact order statistics and exact positions without a one-task window.

`thresholds` finds the k-th smallest (key, tie) pairs by repeated histograms: every pass is a scan with
a map-side combined aggregate of at most `BINS` rows per open range, and the rows themselves are never
sorted or moved. Keys may be infinite or NaN; NaN comes last, as everywhere in Spark. A selection of exactly n rows is then a plain row filter. `exact_rank` is for the
operators that need the position of *every* row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import HASH_RANGE, portable_hash
from .session import cut_lineage

BINS = 2048
FINISH_ROWS = 4096  # a range this small is read back and sorted on the driver; the answer is the same
EXTREMES = (float("-inf"), float("inf"), float("nan"))  # keys that no histogram can hold, with their places in the order


@dataclass(frozen=True)
class _Range:
    """Rows still in question: a range of the key, or of the tie breaker where the key is `pinned`."""

    pinned: object
    lo: object
    hi: object

    def holds(self) -> Column:
        if self.pinned is None:
            return F.col("_k").between(self.lo, self.hi)
        return (F.col("_k") == F.lit(self.pinned)) & F.col("_t").between(self.lo, self.hi)

    def value(self) -> Column:
        return F.col("_k") if self.pinned is None else F.col("_t")

    def bin(self) -> Column:
        if isinstance(self.lo, int) and isinstance(self.hi, int):  # exact, also where a double is not
            return F.floor(F.call_function("div", self.value() - F.lit(self.lo), F.lit((self.hi - self.lo) // BINS + 1)))
        half = float(self.hi) / 2 - float(self.lo) / 2  # halves, so that the widest range is finite
        at = (self.value().cast("double") / 2 - F.lit(float(self.lo) / 2)) / F.lit(half or 1.0) * BINS
        return F.least(F.floor(at), F.lit(BINS - 1)).cast("bigint")


def thresholds(df: DataFrame, key: Column | str, tie: Column | str,
               ranks: list[int] | Callable[[int], list[int]], span: tuple | None = None) -> list[tuple]:
    """The (key, tie) pair at each 1-based rank of the ascending order; `tie` must be unique per key.

    `ranks` may be a function of the number of rows, which is counted here anyway. `span` is the range of a finite key
    where it is known beforehand, and saves the pass that looks for it. Key and tie are written out once, so no pass
    computes the input again.
    """
    work = cut_lineage(df.select(_named(key, "_k"), _named(tie, "_t")).where(F.col("_k").isNotNull()))
    if span is None and dict(work.dtypes)["_k"] in ("double", "float"):
        return _around_extremes(work.withColumn("_k", F.col("_k").cast("double")), ranks)
    first_bins = None
    if span is None:
        total, lo, hi = work.agg(F.count("*"), F.min("_k"), F.max("_k")).first()
    else:
        lo, hi = span
        first_bins = _bins_of(work, [_Range(None, lo, hi)])
        total = sum(b[1] for b in first_bins[_Range(None, lo, hi)])
    ranks = _checked(ranks, total)
    return _search(work, {i: (_Range(None, lo, hi), rank, total) for i, rank in enumerate(ranks)}, first_bins)


def _checked(ranks: list[int] | Callable[[int], list[int]], total: int) -> list[int]:
    ranks = ranks(total) if callable(ranks) else ranks
    for rank in ranks:
        if not 1 <= rank <= total:
            raise ValueError(f"rank {rank} outside 1..{total}")
    return ranks


def _around_extremes(work: DataFrame, ranks: list[int] | Callable[[int], list[int]]) -> list[tuple]:
    """Ranks that fall on an infinite or NaN key are a search by tie alone; the others are a search among finite keys."""
    k = F.col("_k")
    finite = ~F.isnan(k) & (F.abs(k) < float("inf"))
    at = {name: F.when(k == F.lit(v), F.col("_t")) for name, v in zip(("low", "high", "nan"), EXTREMES)}
    stats = work.agg(F.count("*").alias("total"), F.count_if(finite).alias("n"), F.min(F.when(finite, k)).alias("lo"), F.max(F.when(finite, k)).alias("hi"),
                     *[f(c).alias(f"{name}_{part}") for name, c in at.items() for part, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    blocks = [(_Range(EXTREMES[0], stats.low_lo, stats.low_hi), stats.low_n), (_Range(None, stats.lo, stats.hi), stats.n),
              (_Range(EXTREMES[1], stats.high_lo, stats.high_hi), stats.high_n), (_Range(EXTREMES[2], stats.nan_lo, stats.nan_hi), stats.nan_n)]
    open_ = {}
    for i, rank in enumerate(_checked(ranks, stats.total)):
        for rng, n in blocks:
            if rank <= n:
                open_[i] = (rng, rank, n)
                break
            rank -= n
    return _search(work, open_)


def _search(work: DataFrame, open_: dict[int, tuple], first_bins: dict | None = None) -> list[tuple]:
    """open_: number of the answer -> (range that holds it, its rank there, rows there)."""
    found: dict[int, tuple] = {}
    wanted = len(open_)
    while open_:
        small = {i: s for i, s in open_.items() if s[2] <= FINISH_ROWS}
        if small:
            rows = _rows_of(work, [s[0] for s in small.values()])
            for i, (rng, rank, _) in small.items():
                found[i] = rows[rng][rank - 1]
                del open_[i]
        if not open_:
            break
        bins = first_bins or _bins_of(work, [s[0] for s in open_.values()])
        for i, (rng, rank, before) in list(open_.items()):
            for _, n, lo, hi in bins[rng]:
                if rank <= n:
                    break
                rank -= n
            if lo != hi:
                if (lo, hi, n) == (rng.lo, rng.hi, before) and not first_bins:
                    raise RuntimeError(f"no progress between {lo!r} and {hi!r}")
                open_[i] = (_Range(rng.pinned, lo, hi), rank, n)
            elif rng.pinned is not None:
                found[i] = (rng.pinned, lo)
                del open_[i]
            elif n <= FINISH_ROWS:
                open_[i] = (_Range(None, lo, lo), rank, n)
            else:
                tie_ends = work.where(F.col("_k") == F.lit(lo)).agg(F.min("_t"), F.max("_t")).first()
                open_[i] = (_Range(lo, tie_ends[0], tie_ends[1]), rank, n)
        first_bins = None
    return [found[i] for i in range(wanted)]


def group_thresholds(df: DataFrame, by: list[str], key: Column, tie: Column, ranks: dict[str, Column]) -> DataFrame:
    """`thresholds` of many groups and ranks at once: (by, target, key, tie) for each name in `ranks`.

    A rank is an expression over the columns of `by` and `n`, the rows of the group; ranks outside 1..n give no row. Groups are
    never sorted or brought together, so one may hold all rows. What is searched is a table of ranges, a row for each group and
    target; each pass joins the rows to the ranges that hold them and counts at most `BINS` bins of each. Ranges of at most
    `FINISH_ROWS` rows are ranked, each apart from the others. Groups with a null in `by` are left out.
    """
    work = cut_lineage(df.select(*by, key.cast("double").alias("_k"), tie.cast("bigint").alias("_t")).where(F.col("_k").isNotNull()))
    low, high, nan = (F.col("_k") == F.lit(v) for v in EXTREMES)  # values of their own, as nothing lies between them
    kind = F.when(low, 0).when(high, 2).when(nan, 3).otherwise(1)
    ends = [F.count("*").alias("_n"), F.min("_k").alias("_k0"), F.max("_k").alias("_k1"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1")]
    blocks = cut_lineage(work.groupBy(*by, kind.alias("_b")).agg(*ends))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("target"), rank.cast("bigint").alias("_rank")) for name, rank in ranks.items()]))
    targets = (blocks.groupBy(*by).agg(F.sum("_n").alias("n")).withColumn("_w", wanted)
               .where(F.col("_w._rank").between(1, F.col("n"))).select(*by, "_w.*"))
    open_ = cut_lineage(_narrowed(targets, blocks, by))
    where = ["_k0", "_k1", "_t0", "_t1"]
    large = (F.col("_n") > FINISH_ROWS) & ((F.col("_k0") < F.col("_k1")) | (F.col("_t0") < F.col("_t1")))
    while open_.where(large).limit(1).count():
        wide = open_.where(large)
        inside = _inside(work, wide.select(*by, *where).distinct(), by)
        half = F.col("_k1") / 2 - F.col("_k0") / 2
        key_bin = F.when(half > 0, F.least(F.floor((F.col("_k") / 2 - F.col("_k0") / 2) / half * BINS), F.lit(BINS - 1))).otherwise(
            F.when(F.col("_k") == F.col("_k0"), 0).otherwise(1))
        tie_bin = F.call_function("div", F.col("_t") - F.col("_t0"), F.call_function("div", F.col("_t1") - F.col("_t0"), F.lit(BINS)) + 1)
        bin_ = F.when(F.col("_k0") < F.col("_k1"), key_bin).otherwise(tie_bin)
        counted = inside.groupBy(*by, *[F.col(c).alias("_of" + c) for c in where], bin_.alias("_b")).agg(*ends)
        asked = wide.select(*by, "target", "_rank", *[F.col(c).alias("_of" + c) for c in where])
        open_ = cut_lineage(open_.where(~large).unionByName(_narrowed(asked, counted, [*by, *["_of" + c for c in where]]).select(open_.columns)))
    last = Window.partitionBy(*by, *where).orderBy("_k", "_t")
    ranked = _inside(work, open_.select(*by, *where).distinct(), by).withColumn("_rank", F.row_number().over(last).cast("bigint"))
    return ranked.join(open_, [*by, *where, "_rank"]).select(*by, "target", F.col("_k").alias("key"), F.col("_t").alias("tie"))


def _inside(work: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows with each of the ranges that hold them; where a range has one key, its ties count too."""
    r = ranges.select(*[F.col(c).alias("_by" + c) for c in by], "_k0", "_k1", "_t0", "_t1")
    same = [F.col(c) == F.col("_by" + c) for c in by]
    held = F.col("_k").between(F.col("_k0"), F.col("_k1")) & ((F.col("_k0") < F.col("_k1")) | F.col("_t").between(F.col("_t0"), F.col("_t1")))
    on = held
    for c in same:
        on = c & on
    return work.join(r, on).drop(*["_by" + c for c in by])


def _narrowed(targets: DataFrame, bins: DataFrame, at: list[str]) -> DataFrame:
    """The bin that holds each target's rank, and its rank there. A range has few bins, which are summed in order."""
    upto = F.sum("_n").over(Window.partitionBy(*at).orderBy("_b"))
    found = targets.join(bins.withColumn("_upto", upto), at)
    return (found.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
            .withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).drop("_upto", "_b", *[c for c in at if c.startswith("_of")]))


def _named(col: Column | str, name: str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).alias(name)


def _tagged(work: DataFrame, ranges: list[_Range]) -> tuple[DataFrame, list[_Range]]:
    distinct = list(dict.fromkeys(ranges))
    tag = F.coalesce(*[F.when(r.holds(), F.lit(i)) for i, r in enumerate(distinct)])
    # A range with a pinned key lies inside no other open range, so each row has at most one tag.
    return work.withColumn("_r", tag).where(F.col("_r").isNotNull()), distinct


def _bins_of(work: DataFrame, ranges: list[_Range]) -> dict[_Range, list[tuple]]:
    tagged, distinct = _tagged(work, ranges)
    bin_ = F.coalesce(*[F.when(F.col("_r") == i, r.bin()) for i, r in enumerate(distinct)])
    value = F.coalesce(*[F.when(F.col("_r") == i, r.value()) for i, r in enumerate(distinct)]) \
        if len({r.pinned is None for r in distinct}) == 1 else None
    out: dict[_Range, list[tuple]] = {r: [] for r in distinct}
    groups = [(tagged, bin_, value, None)] if value is not None else [
        (tagged.where(F.col("_r") == i), r.bin(), r.value(), i) for i, r in enumerate(distinct)]
    for rows, bin_col, val, _ in groups:
        for row in (rows.groupBy("_r", bin_col.alias("_b"))
                    .agg(F.count("*").alias("n"), F.min(val).alias("lo"), F.max(val).alias("hi")).collect()):
            out[distinct[row["_r"]]].append((row["_b"], row["n"], row["lo"], row["hi"]))
    return {r: sorted(v, key=lambda e: e[0]) for r, v in out.items()}


def _rows_of(work: DataFrame, ranges: list[_Range]) -> dict[_Range, list[tuple]]:
    tagged, distinct = _tagged(work, ranges)
    out: dict[_Range, list[tuple]] = {r: [] for r in distinct}
    for row in tagged.select("_r", "_k", "_t").collect():
        out[distinct[row["_r"]]].append((row["_k"], row["_t"]))
    return {r: sorted(v) if r.pinned is None else sorted(v, key=lambda e: e[1]) for r, v in out.items()}


def consecutive(df: DataFrame, by: str, out: str) -> DataFrame:
    """`df` with the 0-based position of every row in the order of `by`, which should be unique.

    The rows are range-partitioned, sorted and written once; what reaches the driver is one count per partition.
    """
    placed = cut_lineage(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    before, total = {}, 0
    for p, n in sorted(placed.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect()):
        before[p], total = total, total + n
    offsets = F.array(*[F.lit(before.get(p, 0)).cast("bigint") for p in range(max(before, default=0) + 1)])
    return placed.withColumn(out, F.col("_place") - F.shiftleft(part, 33) + F.get(offsets, part.cast("int"))).drop("_place")


def first_n_by(df: DataFrame, n: int | Callable[[int], int], key: Column, tie: str = "row_id",
               span: tuple | None = None) -> Column:
    """Predicate that holds for exactly the n rows smallest by (key, tie). No shuffle of the rows.

    `n` may be a function of the number of rows.
    """
    everything = []

    def ranks(total: int) -> list[int]:
        size = n(total) if callable(n) else n
        everything.append(size >= total)
        return [size] if 0 < size < total else []

    if not callable(n) and n <= 0:
        return F.lit(False)
    cut = thresholds(df, key, tie, ranks, span)
    if not cut:
        return F.lit(everything[0])
    k, t = cut[0]
    return (key < F.lit(k)) | ((key == F.lit(k)) & (F.col(tie) <= F.lit(t)))


def random_n(df: DataFrame, n: int | Callable[[int], int], seed: int | str) -> Column:
    """Predicate for exactly n rows without replacement: the first n in portable hash order."""
    return first_n_by(df, n, portable_hash("row_id", seed), span=(0, HASH_RANGE - 1))


def exact_rank(df: DataFrame, key: Column, tie: str = "row_id", out: str = "rank", by: list[str] = (),
               pieces: int | None = None) -> DataFrame:
    """0-based position of every row under (key, tie), over all rows or within each group of `by`.

    The key range is cut at approximate quantiles. A value that is itself a cut gets a bucket of its own,
    and those buckets are cut again along `tie`, so one value held by a third of all rows still spreads
    over many tasks. Counts per bucket (a bounded table per group) give the offsets.
    """
    if pieces is None:  # a few buckets per shuffle partition
        pieces = max(2, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fractions = [i / pieces for i in range(1, pieces)]
    work = df.withColumn("_k", key.cast("double"))
    cuts = work.agg(F.percentile_approx("_k", fractions, 10 * pieces).alias("k"),
                    F.percentile_approx(F.col(tie).cast("double"), fractions, 10 * pieces).alias("t")).first()
    key_cuts, tie_cuts = sorted(set(cuts["k"] or [])), sorted(set(cuts["t"] or []))
    work = _bucketed(work, "_k", key_cuts, "_b")
    at_cut = F.element_at(F.array(*[F.lit(c) for c in [float("-inf")] + key_cuts]),
                          (F.col("_b") + 1).cast("int")) == F.col("_k")
    work = _bucketed(work.withColumns({"_tie": F.col(tie).cast("double"), "_cut": at_cut}), "_tie", tie_cuts, "_s")
    work = work.withColumns({"_b": F.col("_b") * 2 + F.when(F.col("_cut"), 0).otherwise(1),
                             "_s": F.when(F.col("_cut"), F.col("_s")).otherwise(F.lit(0.0))})
    before = Window.partitionBy(*by).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (work.groupBy(*by, "_b", "_s").count()
               .select(*by, "_b", "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy(*by, "_b", "_s").orderBy("_k", tie)
    return (work.withColumn("_i", F.row_number().over(inside)).join(offsets, [*by, "_b", "_s"])
            .withColumn(out, (F.col("_o") + F.col("_i") - 1).cast("bigint"))
            .drop("_k", "_b", "_s", "_o", "_i", "_tie", "_cut"))


def _bucketed(df: DataFrame, col: str, cuts: list[float], out: str) -> DataFrame:
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    edges = [float("-inf")] + cuts + [float("inf")]
    return Bucketizer(splits=edges, inputCol=col, outputCol=out).transform(df)
