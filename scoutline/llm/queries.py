"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, htmldiff, licenses, linededup, mixing, nbsvm, oddsketch, packing, piecemodel, pii, rules, sql, topk, turnrepair

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_extraction")
def op1(spark, sf):
    return htmldiff.extract(_table(spark, sf, "pages"))


@query("op2_near_duplicates")
def op2(spark, sf):
    return oddsketch.link(_table(spark, sf, "documents"))


HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)"


@query("op3_quality_classifier")
def op3(spark, sf):
    docs = _table(spark, sf, "documents")
    model = nbsvm.train_model(docs, _table(spark, sf, "labels"), "quality", f"NOT {HELD_OUT}")
    return nbsvm.score(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_pattern_packing")
def op4(spark, sf):
    return packing.pack(_table(spark, sf, "documents"))


@query("op5_license_scan")
def op5(spark, sf):
    return licenses.report(licenses.scan(_table(spark, sf, "documents")))


@query("op6_exact_top_k")
def op6(spark, sf):
    return topk.top_k(_table(spark, sf, "embeddings"), "vec_id % 20 = 0")


@query("op7_personal_data")
def op7(spark, sf):
    return pii.report(pii.detect(_table(spark, sf, "documents")))


@query("op8_weighted_mix", sql.MIX)
def op8(spark, sf):
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_line_dedup", sql.LINE_DEDUP)
def op9(spark, sf):
    kept = linededup.dedup_lines(_table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_quality_rules", sql.RULES)
def op10(spark, sf):
    book = rules.apply_policy(rules.ledger(_table(spark, sf, "documents")), "v2")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~rules.passes(F.col("failed"), "base")).alias("base_failed"), "kept", "failed")


@query("op11_tokenizer_alignment")
def op11(spark, sf):
    return alignment.report(_table(spark, sf, "documents"))


@query("op12_piece_round_trip")
def op12(spark, sf):
    return piecemodel.report(piecemodel.decode(piecemodel.encode(_table(spark, sf, "documents"))))


@query("op13_conversation_repair")
def op13(spark, sf):
    return turnrepair.report(turnrepair.damage(_table(spark, sf, "conversations")))
