"""Document fingerprints by spot signatures.

Where a common word (an anchor) stands, it forms a signature with the `CHAIN` content words that follow it. So that
texts with few common words have signatures as well, every word whose hash is a multiple of `SPARSE` is an anchor too;
it counts among the content words of others. Words are runs of letters, digits and non-ASCII symbols. A fingerprint is the set of a text's signatures. The similarities given out are unpruned Jaccard. Length classes (two sets of similarity s or more lie in the same one or
in neighbouring ones) are a column of the result; only `likeness` with a least similarity ends a comparison by them, and
no query asks for one. There is no join by length class.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import partitions
from .hashing import MARKS, mix, shingle_hashes, seeded, word_hashes

# Common words of four languages.
ANCHORS = tuple(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au de des du en est et la le les pas pour que qui sur un une "
    "con de del el en es la las los no para por que se su un una y".split())
CHAIN = 2
SPARSE = 6
ROWS = 1000

OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("length_class", T.IntegerType())])


def signatures(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted set of 32-bit signatures of each text.

    A text without an anchor that a whole chain follows has its words as signatures; one without words has none.
    """
    words, offsets = word_hashes(pa.array(texts, pa.large_string()), breaks=MARKS)
    common = np.isin(words, word_hashes(pa.array(ANCHORS), breaks=MARKS)[0])
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    content = np.flatnonzero(~common)
    spots = np.flatnonzero(common | (words % np.uint64(SPARSE) == 0))
    first = np.searchsorted(content, spots, "right")
    spots, first = spots[first + CHAIN <= len(content)], first[first + CHAIN <= len(content)]
    same = row[content[first + CHAIN - 1]] == row[spots] if len(spots) else np.zeros(0, bool)
    spots, first = spots[same], first[same]
    weights = seeded(CHAIN + 1, 31) | np.uint64(1)
    value = words[spots] * weights[0]
    for i in range(CHAIN):
        value = value + words[content[first + i]] * weights[i + 1]
    value = (mix(value) >> np.uint64(32)).astype(np.uint32)
    ends = np.searchsorted(row[spots], np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        own = value[ends[i]:ends[i + 1]]
        if not len(own):
            own = (shingle_hashes(words[offsets[i]:offsets[i + 1]], 1, weights) >> np.uint64(32)).astype(np.uint32)
        out.append(np.unique(own))
    return out


def written(values: np.ndarray) -> str:
    """A fingerprint as text: its signatures in order, base64 of big-endian 32-bit numbers."""
    return base64.b64encode(values.astype(">u4").tobytes()).decode()


def length_class(n: int, least: float = 0.8) -> int:
    """The class of a set of n signatures; sets that are similar to `least` differ by one class at most."""
    return -1 if n == 0 else int(math.log(n) / math.log(1 / least))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints, 0 as soon as their lengths keep it below `least`; 1 for two empty ones."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if len(short) < least * len(long) or least > 0 and length_class(len(long), least) - length_class(len(short), least) > 1:
        return 0.0
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return both / (len(short) + len(long) - both)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; null and empty texts have the empty one."""
    @F.arrow_udf("string")
    def made(column: pa.Array) -> pa.Array:
        return pa.array([written(s) for at in range(0, len(column), ROWS) for s in signatures(column.slice(at, ROWS).to_pylist())], pa.string())

    return made(text.cast("string"))


def _rows(ids, texts, following):
    """Results of consecutive documents; `following` is the text after the last one."""
    edited = []
    for text, after in zip(texts, [*texts[1:], following], strict=True):
        cut = len(text) // 2
        edited.append(text[:len(text) - cut] + after[:cut])
    own = signatures([*texts, following])
    new = signatures(edited)
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([written(s) for s in own[:-1]], pa.string()), pa.array([written(s) for s in new], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own[:-1], new, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
        pa.array([length_class(len(s)) for s in own[:-1]], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in OUT])


def _compared(parts):
    """Rows come by bucket, a bucket's documents in order and after them the first of the next bucket."""
    ids, texts, bucket = [], [], None
    for part in parts:
        for b, guest, doc, text in zip(*[part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")], strict=True):
            text = text or ""
            if b != bucket:
                ids, texts, bucket = [], [], b
            if guest:
                if ids:
                    yield _rows(ids, texts, text)
                ids, texts = [], []
                continue
            ids.append(doc)
            texts.append(text)
            if len(ids) > ROWS:
                yield _rows(ids[:-1], texts[:-1], texts[-1])
                ids, texts = ids[-1:], texts[-1:]


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    The next document is the one that follows in descending doc_id, null ids last and equal ids in the order of a hash of
    the text; the first follows the last, so a lone document follows itself. The edited text is the text with its last
    half replaced by as much of the next one's beginning. Null texts count as empty.

    Documents are dealt into ranges of ids, cut at quantiles, so that no task has more than its share. The first document
    of each range, found from ids and hashes alone, is sent to the range before it as well.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = partitions(spark)
    shares = [i / parts for i in range(1, parts)]
    cuts = np.array(sorted(set(rows.filter("doc_id is not null").approxQuantile("doc_id", shares, 0.2 / parts) if shares else [])))

    @F.arrow_udf("int")
    def ranged(ids: pa.Array, h: pa.Array) -> pa.Array:
        """Ranges of ids from the largest down; null ids after them, by ranges of the hash."""
        null = np.asarray(ids.is_null())
        number = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(), "right")
        after = len(cuts) + 1 + ((h.to_numpy().astype(np.float64) / 2.0**64 + 0.5) * parts).astype(np.int64).clip(0, parts - 1)
        return pa.array(np.where(null, after, number), pa.int32())

    rows = rows.withColumn("bucket", ranged("doc_id", "h"))
    firsts = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), (-F.col("h").cast("decimal(20,0)")).alias("down"), "h")).alias("f")).select("bucket", "f.doc_id", "f.h").collect()
    if not firsts:
        return spark.createDataFrame([], OUT)
    firsts.sort(key=lambda r: r["bucket"])
    # One row a range, so it may be broadcast.
    guests = spark.createDataFrame([(firsts[i - 1]["bucket"], r["doc_id"], r["h"]) for i, r in enumerate(firsts)], "home int, id long, g long")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))
    sent = rows.join(F.broadcast(guests), same).groupBy("home").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("h").alias("h"))
    sent = sent.select("doc_id", "text", "h", F.col("home").alias("bucket"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(sent).repartitionById(parts, F.pmod("bucket", F.lit(parts)))
    return both.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "h", "text").select("bucket", "guest", "doc_id", "text").mapInArrow(_compared, OUT)
