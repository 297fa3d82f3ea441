"""Versions of a table that share their files: hash buckets of a key, and a manifest per version that says where each lies.

    root/data/commit=<id>/bucket=<k>/    rows of a bucket, as one commit left them; never changed afterwards
    root/manifest/version=<n>/           one small table: for each bucket, the commit that holds its rows
    root/tags/tag=<name>/                a name for a version

A snapshot is a tag: no row is copied. A commit of n keys rewrites at most n buckets, those that hold them; all others stay where
they are. The manifest is written last, so a commit that is lost half way leaves the table as it was, and is done again. A commit
with a `batch` id that a version has already is not repeated. A table has one writer at a time and any number of readers.

Only manifests and the buckets that edits touch reach the driver, at most as many rows as there are buckets, a setting. Buckets
are written by a rebalancing shuffle: Spark splits those that are large, so a key that holds many rows is several files.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commit import apply_history

BUCKETS = 256
MANIFEST = "bucket INT, commit STRING, batch STRING, n_buckets INT, keys ARRAY<STRING>, columns STRING, version BIGINT"


def _bucket(keys: list[str], n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n_buckets)).cast("int")


def _write_buckets(df: DataFrame, root: str, commit: str, bucket: Column) -> None:
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), bucket.alias("bucket"))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/data/commit={commit}")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def last_version(spark: SparkSession, root: str) -> int:
    """The newest version, from 0; -1 if there is no table."""
    newest = _manifests(spark, root).agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def _manifest(spark: SparkSession, root: str, version: int | None) -> list:
    version = last_version(spark, root) if version is None else version
    rows = _manifests(spark, root).where(F.col("version") == version).orderBy("bucket").collect()
    if not rows:
        raise ValueError(f"{root} has no version {version}")
    return rows


def _write_manifest(spark: SparkSession, root: str, version: int, rows: list[tuple]) -> None:
    schema = MANIFEST.rsplit(",", 1)[0]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def _folders(root: str, rows: list) -> list[str]:
    return [f"{root}/data/commit={r['commit']}/bucket={r['bucket']}" for r in rows if r["commit"] is not None]


def _read(spark: SparkSession, root: str, rows: list) -> DataFrame:
    columns = rows[0]["columns"]
    folders = _folders(root, rows)
    schema = f"row STRUCT<{columns}>"
    return (spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)).select("row.*")


def create(df: DataFrame, root: str, keys: list[str], n_buckets: int = BUCKETS) -> int:
    """Store `df` as version 0 of a table whose edits come by `keys`. An existing table is an error."""
    spark = df.sparkSession
    if last_version(spark, root) >= 0:
        raise ValueError(f"{root} is a table already")
    commit = uuid.uuid4().hex
    _write_buckets(df, root, commit, _bucket(keys, n_buckets))
    held = _held(spark, root, commit)
    columns = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema.fields)
    _write_manifest(spark, root, 0, [(b, commit if b in held else None, None, n_buckets, list(keys), columns) for b in range(n_buckets)])
    return 0


def _held(spark: SparkSession, root: str, commit: str) -> set[int]:
    """The buckets a commit has written: names of folders, no file is read."""
    path = f"{root}/data/commit={commit}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [s.getPath().getName() for s in listed]
    return {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}


def read_version(spark: SparkSession, root: str, version: int | str | None = None) -> DataFrame:
    """The rows of a version, given by number or tag; of the newest if none is given."""
    return _read(spark, root, _manifest(spark, root, tagged(spark, root, version) if isinstance(version, str) else version))


def tag(spark: SparkSession, root: str, name: str, version: int | None = None) -> int:
    """Name a version, the newest if none is given. A name is never given twice."""
    version = _manifest(spark, root, version)[0]["version"]
    spark.createDataFrame([(version,)], "version BIGINT").coalesce(1).write.mode("errorifexists").parquet(f"{root}/tags/tag={name}")
    return version


def tagged(spark: SparkSession, root: str, name: str) -> int:
    return spark.read.schema("version BIGINT").parquet(f"{root}/tags/tag={name}").first()[0]


def commit_edits(spark: SparkSession, root: str, edits: DataFrame, seq: list[str], label: str = "yield", batch: str | int | None = None) -> int:
    """Set `label` of the rows that match edits (keys, seq, label) by the table's keys, the later edit winning, as a new version.

    The version is returned; edits without rows, or a batch that is in the table, make none and give the newest.
    """
    rows = _manifest(spark, root, None)
    newest, n_buckets, keys, columns = rows[0]["version"], rows[0]["n_buckets"], rows[0]["keys"], rows[0]["columns"]
    batch = None if batch is None else str(batch)
    if batch is not None and _manifests(spark, root).where(F.col("batch") == batch).limit(1).count():
        return newest
    edits = edits.select(*keys, *seq, label)
    touched = {r[0] for r in edits.select(_bucket(keys, n_buckets)).distinct().collect()}
    changed = [r for r in rows if r["bucket"] in touched and r["commit"] is not None]
    if not changed:
        return newest
    commit = uuid.uuid4().hex
    _write_buckets(apply_history(_read(spark, root, changed), edits, keys, seq, label), root, commit, _bucket(keys, n_buckets))
    new = {r["bucket"] for r in changed}
    _write_manifest(spark, root, newest + 1, [(r["bucket"], commit if r["bucket"] in new else r["commit"], batch, n_buckets, keys, columns) for r in rows])
    return newest + 1
