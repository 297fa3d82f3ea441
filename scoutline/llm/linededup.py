"""Line deduplication: lines shared by many documents stay in one of them; the result is a keep bitmap per document.

Lines long enough to count become 128-bit hashes of their keys. The (hash, document, position) rows are range-partitioned
on hash and document and written sorted; a frequent line is spread over several partitions because the document is part
of the range. Counts and the keeping document come from aggregating those rows, which does not use their order. Only shared hashes meet the rows again; their positions become bitmaps, 64 lines to a word, with only
the words that lose a line stored. The text itself is not in any of these shuffles.

Null or empty texts are one empty line. Rows with the same id are one document (a null id, too, is one document); rows that
also have the same text share a bitmap. Null ids never keep a line if a document with an id holds it. Empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .common import SPACES, ascii_lower, shift_left, shift_right, text_of

MIN_CHARS, MIN_DOCS = 40, 5


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of every line whose key has at least `min_chars` code points, sorted by range."""
    lines = (docs.select(F.col("doc_id"), text_of().alias("t"))
             .select("doc_id", F.xxhash64("t").alias("text_hash"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
             .select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(SPACES)).alias("line"))
             .filter(F.length("line") >= min_chars)
             .select("doc_id", "text_hash", "pos", ascii_lower(F.col("line")).alias("key")))
    return (lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")
            .repartitionByRange("h1", "h2", "doc_id", "pos").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, keep: MAP<INT, BIGINT>) of the documents that lose lines.

    keep[w] holds lines 64 w to 64 w + 63, a set bit keeps the line; a word that is absent keeps all its lines.
    """
    rows = cut_lineage(occurrences(docs, min_chars))
    shared = cut_lineage(rows.select("h1", "h2", "doc_id").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
                         .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
                         .filter(F.col("n_docs") >= min_docs))
    lost = (rows.join(shared, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .select("doc_id", "text_hash", (F.col("pos") / 64).cast("int").alias("word"),
                    shift_left(F.lit(1).cast("bigint"), F.col("pos") % 64).alias("bit")))
    return (lost.groupBy("doc_id", "text_hash", "word").agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
            .groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep")))


def _kept(lines: Column, keep: Column) -> Column:
    return F.filter(lines, lambda _, i: shift_right(F.coalesce(F.try_element_at(keep, (i / 64).cast("int")), F.lit(-1).cast("bigint")), i % 64)
                    .bitwiseAND(F.lit(1).cast("bigint")) == 1)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with their shared lines left out of `text`, and n_lines, n_dropped. All other columns are kept."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marks = bitmaps.select("doc_id", "text_hash", "keep")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_of().alias("t"))
    joined = (rows.join(marks, F.col("id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("t") == F.col("text_hash")), "left")
              .withColumn("all", F.split("t", "\n")).withColumn("kept", F.when(F.col("keep").isNotNull(), _kept(F.col("all"), F.col("keep")))))
    return joined.select(*[(F.coalesce(F.array_join("kept", "\n"), F.col("t")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names],
                         F.size("all").cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("all") - F.size("kept"), F.lit(0)).cast("bigint").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
