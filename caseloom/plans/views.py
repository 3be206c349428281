"""The given tables seen as cases, predictions, series and volumes."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import any_of
from ..operators.prefix import row_numbers
from ..operators.rules import Cues, Rule, RuleBook
from ..schema import PLANES
from ..session import partitions, shared_dir, spread
from ..sources.files import slice_files

DOC_LABELS = ["quality", "toxic"]
ORDER_LABELS = ["filled", "urgent"]
ORDER_SOURCES = ["disc", "qty", "tax"]
EMBEDDING_SIDE = 8
LINES_A_TASK = 2_000_000
# One row a file; tasks move their files into place themselves, as the driver would take them one by one.
FILE_BY_FILE = {"maxRecordsPerFile": "1", "mapreduce.fileoutputcommitter.algorithm.version": "2"}

# Rules on the vocabulary of the documents: one label by a single pattern, one by a pattern and a companion.
DOCUMENT_RULES = RuleBook(
    labels=tuple(DOC_LABELS),
    rules=(
        Rule("quality", (any_of(r"\b[a-z]+tion\b", r"\b[a-z]+heit\b", r"\b[a-z]+ment\b", r"\b[a-z]+cion\b"),
                         any_of(r"\bthe\b", r"\bder\b", r"\bles\b", r"\blos\b")), (3,)),
        Rule("toxic", (any_of(r"\bidiot\b", r"\btrash\b", r"\bworthless\b"),)),
    ),
    cues=Cues(
        pre_negation=(r"no", r"not", r"nicht", r"ohne", r"sin", r"sans", r"of"),
        post_negation=(r"nicht", r"as", r"en"),
        uncertain=(r"ist", r"by", r"pour", r"como"),
        terminators=(r"and", r"with", r"und", r"mit", r"y", r"con", r"et", r"avec"),
    ),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.col("text").alias("report")))


def document_cases(spark: SparkSession, sf: str) -> DataFrame:
    truth = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("case_id"), *DOC_LABELS)
    return documents(spark, sf).join(truth, "case_id", "left")


# Sentences of the knee reports, with the findings the rule book must see in them (1 affirmed, 0.5 uncertain).
KNEE_SENTENCES = (
    ("complete tear of the anterior cruciate ligament", {"ACL": 1.0}),
    ("no rupture of the anterior cruciate ligament", {}),
    ("possible sprain of the medial collateral ligament", {"MCL": 0.5}),
    ("horizontal tear of the medial meniscus", {"Medial Meniscus": 1.0}),
    ("the lateral meniscus shows a flap tear", {"Lateral Meniscus": 1.0}),
    ("large joint effusion", {"Effusion": 1.0}),
    ("without effusion", {}),
    ("kein erguss", {}),
    ("verdacht auf erguss", {"Effusion": 0.5}),
    ("sinovitis", {"Synovitis": 1.0}),
    ("small baker cyst", {"Baker's": 1.0}),
    ("bone bruise", {"Contusion": 1.0}),
    ("pas de fracture", {}),
    ("fracture cannot be excluded", {"Fracture": 0.5}),
    ("fraktur", {"Fracture": 1.0}),
    ("unremarkable study", {}),
)


def knee_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Two sentences for every order: one by its key, one by a further digit of it."""
    said = F.array(*[F.lit(s) for s, _ in KNEE_SENTENCES])
    n = len(KNEE_SENTENCES)
    pick = lambda key: F.element_at(said, (key % n + 1).cast("int"))
    key = F.col("o_orderkey")
    return spread(table(spark, sf, "orders").select("o_orderkey")).select(key.cast("string").alias("case_id"), F.concat(
        pick(key), F.lit(".\n"), pick(F.floor(key / 7)), F.lit(".")).alias("report"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Wide truth of the orders, unknown for partly filled ones and for medium priority."""
    status, priority = F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1)).cast("int")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_custkey").alias("customer"),
        F.when(status == "F", 1.0).when(status == "O", 0.0).alias("filled"),
        F.when(priority <= 2, 1.0).when(priority >= 4, 0.0).alias("urgent"))


def order_truth(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).alias("y")) for l in ORDER_LABELS])
    return orders(spark, sf).select("case_id", F.inline(cells))


def order_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources that score orders from their lines; orders without the lines a source needs are missing."""
    lines = table(spark, sf, "lineitem")
    per_order = lines.groupBy(F.col("l_orderkey").cast("string").alias("case_id")).agg(
        F.count("*").alias("n"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
        F.sum(F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("long"))).alias("qty"),
        F.sum(F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 100).cast("long"))).alias("tax"))
    if (tasks := -(-lines.count() // LINES_A_TASK)) > 1:  # few bytes a line become many rows, so merging by bytes makes large tasks
        per_order = per_order.repartition(max(tasks, partitions(spark)), "case_id")
    scaled = {"disc": F.col("disc") / (F.col("n") * 10.0), "qty": F.col("qty") / (F.col("n") * 50.0),
              "tax": F.col("tax") / (F.col("n") * 8.0)}
    cells = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(l).alias("label"), (p if l == "filled" else 1 - p).alias("p"))
                      for s, p in scaled.items() for l in ORDER_LABELS])
    return per_order.select("case_id", F.inline(cells)).filter("p is not null").select("source", "case_id", "label", "p")


def order_predictions_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The predictions, of which some are NaN and some NULL; one source has none at all for one label."""
    key = F.col("case_id").cast("long")
    gone = (key % 10 == 0) | ((F.col("source") == "tax") & (key % 7 == 1)) | ((F.col("source") == "qty") & (F.col("label") == "urgent"))
    return order_predictions(spark, sf).withColumn("p", F.when(~gone, F.col("p")).when(key % 3 == 0, F.lit(float("nan"))))


def order_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources that complement each other: each hears the truth in a third of the orders, one better than the other, over uniform noise."""
    cells, sources = spread(order_truth(spark, sf)), ["first", "second", "third"]
    digits = F.left(F.md5(F.concat_ws(":", "source", "label", "case_id")), F.lit(13))
    noise = F.conv(digits, 16, 10).cast("double") / float(2 ** 52)
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    heard = F.pmod(F.col("case_id").cast("long"), F.lit(3)) == place - 1
    spoken = cells.select("*", F.explode(F.array(*map(F.lit, sources))).alias("source"))
    return spoken.select("source", "case_id", "label", (noise + F.when(heard & (F.col("y") == 1), place * 0.25).otherwise(0.0)).alias("p"))


def order_scores(spark: SparkSession, sf: str) -> DataFrame:
    return order_predictions(spark, sf).join(order_truth(spark, sf), ["case_id", "label"])


def order_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by customer, so all orders of a customer share one."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"),
                                             F.pmod("o_custkey", F.lit(5)).cast("int").alias("fold"))


def slice_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as slice headers: the user is the case, the event type the series.

    Some have no position, some series share positions, some frames have another size, some are unreadable.
    """
    e, kind, cents = F.col("event_id"), F.col("event_type"), F.round(F.col("value") * 100).cast("long")
    directions = {"view": [0, 1, 0, 0, 0, -1], "click": [1, 0, 0, 0, 0, -1], "error": [1, 0, 0, 0, 1, 0],
                  "purchase": [0, -1, 0, 0, 0, -1]}
    oriented = F
    for name, vector in directions.items():
        oriented = oriented.when(kind == name, F.array(*[F.lit(float(v)) for v in vector]))
    place = F.floor(cents / 500).cast("double")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("case_id"), kind.alias("series_id"),
        F.lpad(e.cast("string"), 12, "0").alias("path"),
        F.pmod(e, F.lit(97)).cast("int").alias("instance_number"),
        F.when((kind != "click") | (F.pmod(e, F.lit(40)) != 0), F.array(place, place * 2, place * 3)).alias("position"),
        oriented.alias("orientation"),
        F.when(F.pmod(e, F.lit(10)) == 0, 256).otherwise(512).alias("rows"), F.lit(512).alias("cols"),
        (F.pmod(e, F.lit(53)) != 0).alias("readable"),
        F.when(F.pmod(e, F.lit(2)) == 0, "explicit").otherwise("implicit").alias("transfer_syntax"))


def listed_series(spark: SparkSession, sf: str) -> DataFrame:
    """What a series table says: series of users with an event above 5, and one series of every customer."""
    kind = F.col("event_type")
    seen = table(spark, sf, "events").filter(F.col("value") > 5).select("user_id", "event_type").distinct().select(
        F.col("user_id").cast("string").alias("case_id"), kind.alias("series_id"),
        kind.isin("view", "purchase").cast("int").alias("fluid"), F.pmod("user_id", F.lit(2)).cast("int").alias("fatsat"),
        F.when(kind == "view", "sagittal").when(kind == "signup", "coronal").when(kind == "purchase", "axial").alias("plane"))
    own = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.lit("survey").alias("series_id"),
        F.lit(0).alias("fluid"), F.lit(1).alias("fatsat"), F.lit("axial").alias("plane"))
    return seen.unionByName(own)


def study_files(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as one slice file each, written and listed: label = series, three labels a case, plane by orientation.

    Some have no header, some another size, some share a place, some do not decode or decode to another size; one series is
    unreadable throughout and one does not decode at all.
    """
    place, label = F.floor(F.col("vec_id") / 20), F.col("label")
    directions = F.array(*[F.array(*[F.lit(float(v)) for v in d]) for d in ([0, 1, 0, 0, 0, -1], [1, 0, 0, 0, 0, -1], [1, 0, 0, 0, 1, 0])])
    odd = F.pmod("vec_id", F.lit(13)) == 5
    lost = (place % 19 == 7) | (label == 7)
    content = F.to_json(F.struct(
        F.col("vec_id").alias("instance_number"), F.transform(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), lambda x: x * place).alias("position"),
        directions[F.pmod("label", F.lit(3))].alias("orientation"), F.array(label + 1.0, label + 2.0).alias("pixel_spacing"),
        F.when(odd, 4).otherwise(8).alias("rows"), F.when(odd, 16).otherwise(8).alias("cols"),
        F.when(place % 2 == 0, "explicit").otherwise("implicit").alias("transfer_syntax"),
        F.when(odd, F.array(F.lit(4), F.lit(16))).when(place % 23 == 9, F.array(F.lit(16), F.lit(4))).otherwise(F.array(F.lit(8), F.lit(8))).alias("shape"),
        F.when(lost, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("pixels")))
    rows = table(spark, sf, "embeddings").select(
        F.floor(label / 3).cast("string").alias("case_id"), label.cast("string").alias("series_id"),
        F.when((label == 4) | ((F.pmod("vec_id", F.lit(17)) == 3) & ~label.isin(2, 8)), "corrupt").otherwise(content).alias("value"))
    root = f"{shared_dir(spark).rstrip('/')}/slices/{uuid.uuid4().hex}"
    # A number of its own: rows are small and files are not, so merging by bytes or by series would leave few writers.
    rows.repartition(partitions(spark)).write.options(**FILE_BY_FILE).partitionBy("case_id", "series_id").text(root)
    return slice_files(spark, root, "*.txt")


def study_series(spark: SparkSession, sf: str) -> DataFrame:
    """The series table of those files: one series is not in it, and one a case has no files."""
    labels = table(spark, sf, "embeddings").select("label").distinct()
    plane = F.element_at(F.array(*[F.lit(p) for p in PLANES]), F.pmod("label", F.lit(3)) + 1)
    case_id = F.floor(F.col("label") / 3).cast("string").alias("case_id")
    own = labels.filter("label <> 8").select(
        case_id, F.col("label").cast("string").alias("series_id"), F.pmod("label", F.lit(2)).cast("int").alias("fluid"),
        (F.pmod("label", F.lit(4)) == 0).cast("int").alias("fatsat"), F.when(F.col("label") != 2, plane).alias("plane"))
    lost = labels.select(case_id, F.lit("lost").alias("series_id"), F.lit(1).alias("fluid"), F.lit(1).alias("fatsat"), F.lit("axial").alias("plane")).distinct()
    return own.unionByName(lost)


def read_slice_header(content: bytes) -> dict:
    return json.loads(content)


def decode_slice(content: bytes) -> dict:
    got = json.loads(content)
    return {"transfer_syntax": got["transfer_syntax"], "pixels": np.array(got["pixels"], np.float32).reshape(got["shape"])}


def decode_raw_slice(content: bytes) -> dict:
    """The same as a raw frame: to be doubled and lowered by one, and inverted in one of the two syntaxes."""
    got = decode_slice(content)
    return got | {"slope": 2.0, "intercept": -1.0, "inverted": got["transfer_syntax"] == "implicit"}


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8 x 8 frames: a label is a series, three labels in a row are the planes of a case."""
    rows = table(spark, sf, "embeddings").select(
        F.floor(F.col("label") / 3).cast("string").alias("case_id"), F.col("label").cast("string").alias("series_id"),
        F.element_at(F.array(*[F.lit(p) for p in PLANES]), F.pmod("label", F.lit(3)) + 1).alias("plane"),
        F.col("vec_id"), F.lit(EMBEDDING_SIDE).alias("h"), F.lit(EMBEDDING_SIDE).alias("w"),
        F.col("embedding").alias("pixels"))
    return row_numbers(rows, ["case_id", "series_id"], [F.col("vec_id")], "slice_idx")
