"""The corpus pipeline: documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import chosenpath, langid, lines, packing, toxicity
from caseloom.llm.queries import remainder, table, word_bpe
from caseloom.session import written_table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; null and empty texts get the score of a text without evidence."""
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(labels, docs)
    return docs.filter(toxicity.scored(model, docs) < 0.5)


def spoken(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: its posterior is at least a half, and the text's mean log-probability under it is
    not far below what texts of that language have.

    Texts without a letter, and null ones, go; so do symbols, random letters and languages that were not learned. Where no
    row names its language there is nothing to tell languages apart by, and every text with a letter stays. Languages are
    learned from rows whose crc32(doc_id) mod 4 is not 2; what is usual for them, from all rows that bear their language.
    """
    model = langid.fit(docs.filter(remainder(4) != 2))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = docs.select("lang", langid.measured(model, docs).alias("m"))
    usual = langid.usual(named)
    found = docs.withColumn("_m", langid.measured(model, docs))
    return found.filter((F.col("_m.score") >= 0.5) & langid.is_usual(usual, "_m")).select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them have. A null or empty text is one empty line, and stays empty."""
    out = lines.dedup_lines(docs, min_docs=10)
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Texts without a word (null ones too) are linked with nothing and stay.
    """
    return chosenpath.keep_one(docs, size=5, num=80, den=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 tokens. A null or empty text is its end token alone."""
    return packing.pack(docs, word_bpe())


STAGES = [("toxicity", clean), ("language", spoken), ("line_dedup", fresh_lines), ("near_dedup", distinct), ("packing", packed)]

ORACLE_SQL = None  # trained models, sketches and differencing cannot be put into SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
