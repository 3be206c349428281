"""The registered queries of the training-data operators; each reads whole tables and returns digests of real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bond, bpe, chosenpath, extract, hyperplane, langid, lines, logbilinear, merkle, packing, spotsigs, toxicity, transport

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op1_crf_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract.main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def word_bpe() -> str:
    """The vocabulary file of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_bpe(spark, sf):
    path = word_bpe()
    return bpe.digests(bpe.encode(table(spark, sf, "documents"), path), path)


@query
def op3_line_dedup(spark, sf):
    out = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op4_transport_stream(spark, sf):
    return transport.read(transport.store(table(spark, sf, "documents")))


@query
def op5_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), word_bpe())


@query
def op6_spot_signatures(spark, sf):
    return spotsigs.edited_likeness(table(spark, sf, "documents"))


@query
def op7_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = langid.fit(docs.filter(remainder(4) != 2))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predicted(model, docs).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


@query
def op8_log_bilinear(spark, sf):
    return logbilinear.scores(table(spark, sf, "documents"), remainder(10) == 0, remainder(10) != 0)


@query
def op9_chosen_path(spark, sf):
    out = chosenpath.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), size=3, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").filter(remainder(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(labels, docs)
    return docs.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), toxicity.scored(model, docs).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op11_merkle_climb(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"), remainder(3) == 0)


@query
def op12_hyperplane_dedup(spark, sf):
    return hyperplane.near_duplicates(table(spark, sf, "embeddings"), 0.95)


@query
def op13_bond_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, moved)
