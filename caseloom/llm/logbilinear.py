"""Log-bilinear language model scoring.

The model predicts the class of the next token from the classes of the two before it: the context's vector is a sum of
linear maps of the classes' vectors, and a class's score is its product with that class's vector plus a bias. Classes
are the most frequent words, the end, buckets of the other words by first and last byte, and one class of rare words. A
word's probability is its class's times its share of the class: by counts in a bucket, by Good-Turing masses among rare
words, where one slot stands for all unknown ones. So probabilities of all known words and the slot sum to 1.

Counts of all words of all training texts are gathered in Spark, and so are the counts of (two classes, class), over
which the model is fitted by noise-contrastive estimation, each step over all counted events. There are at most CLASSES ** 3 of
the latter, whatever the corpus. All contexts are then normalised by one matrix product, and scoring is a lookup.

Tokens of common words (at most COMMON, broadcast) are looked up where they are; the others are joined with the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .hashing import LOWER, column_bytes, mix, run_hashes, seeded, word_runs

TOP, SIGNS = 96, 32
BEGIN, END, FIRST = 0, 1, 2
RARE = FIRST + TOP + SIGNS
CLASSES = RARE + 1
FEW = 2  # counts up to which a word is rare
COMMON = 1 << 18  # words that are broadcast: their hashes and counts take 16 bytes each
EXTRA = 0.1  # added to each count of the base
DIM, STEPS, NOISE, RATE = 24, 600, 64, 0.02
ROWS = 1000  # texts worked on at a time

EVENTS = ("kind string, rid long, doc_id long, held_out boolean, train boolean, n_tokens long, n_known long, base double, within double, "
          "cells binary, word long, context int, cell int, n long")


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and signs (buckets by first and last byte) of all words, and the offsets of the rows."""
    data, offsets = column_bytes(column)
    starts, ends = word_runs(data, offsets)
    symbol = seeded(256, 3)[LOWER]
    hashes = run_hashes(lambda a, b: symbol[data[a:b]], starts, ends)
    edge = LOWER[data[starts]].astype(np.uint64) << np.uint64(8) | LOWER[data[ends - 1]]
    return hashes, (mix(edge + np.uint64(77)) % np.uint64(SIGNS)).astype(np.int32), np.searchsorted(starts, offsets)


def _count(parts):
    """(word, sign, n) of the words of each batch of texts."""
    for part in parts:
        pieces = []
        for at in range(0, part.num_rows, ROWS):
            hashes, sign, _ = words(part.column(0).slice(at, ROWS))
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            pieces.append((found, sign[first], n))
        if pieces:
            found, first, place = np.unique(np.concatenate([x[0] for x in pieces]), return_index=True, return_inverse=True)
            sign, n = np.concatenate([x[1] for x in pieces])[first], np.bincount(place, np.concatenate([x[2] for x in pieces]), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(sign, pa.int32()), pa.array(n.astype(np.int64))], ["word", "sign", "n"])


@dataclass
class Counts:
    """What is known of the training tokens, all of bounded size."""

    total: int  # N
    kinds: int  # V
    ends: int
    word: np.ndarray  # hashes of the common words, sorted
    count: np.ndarray
    klass: np.ndarray  # as context
    target: np.ndarray  # as predicted class
    within: np.ndarray  # log10 share of the class
    bucket: np.ndarray  # tokens of each sign's bucket
    rare: np.ndarray  # log10 share of one word of count 0, 1 .. FEW in the rare class

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + EXTRA) / (self.total + EXTRA * (self.kinds + 1)))


def rare_shares(types: list[int]) -> np.ndarray:
    """log10 share of one word of count 0 .. FEW; `types` has the number of words of count 1 .. FEW + 1.

    A count r gets the Good-Turing mass (r + 1) * types[r + 1], a little smoothed, dealt to the words that have it.
    """
    mass = np.array([(r + 1) * types[r] + 0.5 for r in range(FEW + 1)])
    held = np.array([1, *types[:FEW]], float)
    mass *= held > 0
    with np.errstate(divide="ignore"):
        return np.log10(mass / mass.sum() / np.maximum(held, 1))


def gather(table: DataFrame, ends: int) -> Counts:
    """The counts' summary; `table` has (word, sign, c)."""
    total = table.agg(F.sum("c"), F.count("*")).first()
    octave = F.floor(F.log2("c") * 8).cast("int")
    sizes = table.groupBy(octave.alias("o")).agg(F.count("*").alias("k"), F.min("c").alias("least")).orderBy(F.desc("o")).collect()
    least, held = None, 0
    for row in sizes:  # at most 8 a doubling
        held += row["k"]
        if held > COMMON:
            break
        least = row["least"]
    common = table.filter(F.col("c") >= (least or 0) if least is not None else F.lit(False)).toArrow()
    top = common.sort_by([("c", "descending"), ("word", "ascending")]).slice(0, TOP)["word"].to_numpy()
    few = {r["c"]: r["k"] for r in table.filter(F.col("c") <= FEW + 1).groupBy("c").agg(F.count("*").alias("k")).collect()}
    bucket = np.zeros(SIGNS)
    rest = table.filter((F.col("c") > FEW) & ~F.col("word").isin(top.tolist())) if len(top) else table
    for row in rest.filter(F.col("c") > FEW).groupBy("sign").agg(F.sum("c").alias("n")).collect():
        bucket[row["sign"]] = row["n"]
    rare = rare_shares([few.get(i, 0) for i in range(1, FEW + 2)])
    # Sorted as unsigned numbers, as the tasks look them up.
    word = common["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    word, count, sign = word[order], common["c"].to_numpy()[order], common["sign"].to_numpy()[order]
    place = {h: i for i, h in enumerate(top.view(np.uint64).tolist())}
    rank = np.array([place.get(h, -1) for h in word.tolist()], np.int32)
    klass = np.where(rank >= 0, FIRST + rank, FIRST + TOP + sign).astype(np.int32)
    is_rare = (count <= FEW) & (rank < 0)
    target = np.where(is_rare, RARE, klass).astype(np.int32)
    with np.errstate(divide="ignore"):
        share = np.log10(count / np.maximum(1, bucket[sign]))
    within = np.where(rank >= 0, 0.0, np.where(is_rare, rare[np.minimum(count, FEW)], share))
    return Counts(int(total[0] or 0) + ends, int(total[1]) + (ends > 0), ends, word, count, klass, target, within, bucket, rare)


def _events(shared):
    """Per text what its common tokens give and the cells of the model they use; the other tokens; counts of the cells."""
    def run(parts):
        from pyspark import TaskContext

        counts = shared.value
        rid = TaskContext.get().partitionId() << 40
        cells_seen = np.zeros(CLASSES ** 3, np.int64)
        names = [c.split()[0] for c in EVENTS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

        def batch(kind: str, size: int, **columns):
            got = [pa.array([kind] * size, pa.string()), *[columns[c] if c in columns else pa.nulls(size, t) for c, t in zip(names[1:], kinds[1:], strict=True)]]
            return pa.RecordBatch.from_arrays(got, names)

        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                n = some.num_rows
                train = some.column("train").to_numpy(zero_copy_only=False).astype(bool)
                ids = rid + np.arange(n)
                rid += n
                hashes, sign, offsets = words(some.column("text"))
                row = np.repeat(np.arange(n), np.diff(offsets))
                if len(counts.word):
                    place = np.minimum(np.searchsorted(counts.word, hashes), len(counts.word) - 1)
                    common = counts.word[place] == hashes
                else:
                    place, common = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                # Tokens are the words and one end a row.
                spot, end = np.arange(len(hashes)) + row, offsets[1:] + np.arange(n)
                klass = np.full(len(hashes) + n, END, np.int32)
                klass[spot] = np.where(common, counts.klass[place] if len(counts.word) else 0, FIRST + TOP + sign)
                first = offsets[:-1] + np.arange(n)
                one, two = np.full(len(klass) + 2, BEGIN, np.int32), np.full(len(klass) + 2, BEGIN, np.int32)
                one[1:-1], two[2:] = klass, klass
                one[first] = BEGIN
                two[first] = BEGIN
                two[first[end > first] + 1] = BEGIN
                context = two[:len(klass)] * CLASSES + one[:len(klass)]
                known_at, other = spot[common], spot[~common]
                cell = np.concatenate([context[known_at] * CLASSES + counts.target[place[common]] if len(counts.word) else np.zeros(0, np.int32), context[end] * CLASSES + END])
                cell_row = np.concatenate([row[common], np.arange(n)])
                c = counts.count[place[common]] if len(counts.word) else np.zeros(0)
                base = np.bincount(row[common], weights=counts.base(c), minlength=n) + counts.base(np.array([counts.ends]))[0]
                within = np.bincount(row[common], weights=counts.within[place[common]], minlength=n) if len(counts.word) else np.zeros(n)
                known = np.bincount(row[common], minlength=n) + (counts.ends > 0)
                np.add.at(cells_seen, cell[train[cell_row]], 1)  # in place: a count of each batch would be as large
                order = np.lexsort((cell, cell_row))
                stops = np.cumsum(np.bincount(cell_row, minlength=n)) * 4
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32).tobytes()), pa.py_buffer(cell[order].astype(np.int32).tobytes())])
                yield batch("text", n, rid=pa.array(ids), doc_id=some.column("doc_id"), held_out=some.column("held_out"), train=some.column("train"),
                            n_tokens=pa.array(np.diff(offsets) + 1, pa.int64()), n_known=pa.array(known, pa.int64()), base=pa.array(base), within=pa.array(within), cells=packed)
                owner = row[~common]
                yield batch("word", len(other), rid=pa.array(ids[owner]), train=pa.array(train[owner]), word=pa.array(hashes[~common].view(np.int64)), context=pa.array(context[other], pa.int32()))
        found = np.flatnonzero(cells_seen)
        yield batch("cell", len(found), cell=pa.array(found, pa.int32()), n=pa.array(cells_seen[found], pa.int64()))

    return run


def fit(cell: np.ndarray, n: np.ndarray, seed: int = 9) -> np.ndarray:
    """log10 P(class | two classes before) of all cells, float32, from the counts of the cells.

    Noise-contrastive estimation: the events of each cell against NOISE classes for each of them, of the classes'
    frequency, with Adam. Nothing is drawn: a step takes the expectation over all counted events and all noise classes,
    at a cost that depends on the number of cells only. Then one matrix product normalises all contexts. No cells give
    the same probability to every class.
    """
    rng = np.random.default_rng(seed)
    target, context = cell % CLASSES, cell // CLASSES
    unigram = np.bincount(target, weights=n, minlength=CLASSES) + 0.5
    unigram[BEGIN] = 0
    unigram /= unigram.sum()
    log_q = np.log(np.maximum(unigram, 1e-30))
    p = {"r": rng.standard_normal((CLASSES, DIM)) * 0.3, "q": rng.standard_normal((CLASSES, DIM)) * 0.1,
         "c1": np.eye(DIM) + rng.standard_normal((DIM, DIM)) * 0.05, "c2": np.eye(DIM) * 0.5 + rng.standard_normal((DIM, DIM)) * 0.05, "b": log_q.copy()}
    p = {k: x.astype(np.float32) for k, x in p.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    if len(cell):
        seen, row = np.unique(context, return_inverse=True)
        w2, w1 = seen // CLASSES, seen % CLASSES
        data = np.zeros((len(seen), CLASSES), np.float32)
        data[row, target] = n / n.sum()
        both = data + (NOISE * data.sum(1, keepdims=True) * unigram).astype(np.float32)
        level = (np.log(NOISE) + log_q).astype(np.float32)
        for step in range(1, STEPS + 1):
            u = (p["r"] @ p["c1"])[w1] + (p["r"] @ p["c2"])[w2]
            with np.errstate(over="ignore"):
                g = both / (1 + np.exp(level - p["b"] - u @ p["q"].T)) - data
            du = g @ p["q"]
            d1, d2 = _summed(w1, du), _summed(w2, du)
            grad = {"q": g.T @ u, "b": g.sum(0), "c1": p["r"].T @ d1, "c2": p["r"].T @ d2, "r": d1 @ p["c1"].T + d2 @ p["c2"].T}
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, x in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-12)
    first, second = p["r"] @ p["c1"], p["r"] @ p["c2"]
    table = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
    allowed = np.where(np.arange(CLASSES) == BEGIN, -np.inf, 0)
    for w2 in range(CLASSES):  # a matrix product for each further class of context
        score = (first + second[w2]) @ p["q"].T + p["b"] + allowed
        score -= score.max(1, keepdims=True)
        table[w2] = ((score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)
    return table.reshape(-1)


def _summed(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by class, as a product with the one-hot matrix."""
    return (np.arange(CLASSES)[:, None] == index[None, :]).astype(rows.dtype) @ rows


def _text_scores(table):
    def run(parts):
        for part in parts:
            sizes = np.array([len(x.as_buffer()) // 4 for x in part.column("cells")], np.int64)
            flat = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.int32)
            value = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=table.value[flat], minlength=len(sizes))
            names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "within"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(value)], [*names, "value"])

    return run


def scores(docs: DataFrame, held_out: Column, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows with `train`.

    A null or empty text is its end alone. Null conditions count as false, repeated rows are scored each and counted
    each. Without training rows every token is unknown: base_score is 0 and the model gives all classes one probability.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(train, F.lit(False)).alias("train"))
    ends = rows.filter("train").count()
    counted = rows.filter("train").select("text").mapInArrow(_count, "word long, sign int, n long")
    table = written_table(counted.groupBy("word", "sign").agg(F.sum("n").alias("c")), "word-counts")
    counts = gather(table, ends)
    shared = spark.sparkContext.broadcast(counts)
    events = written_table(rows.mapInArrow(_events(shared), EVENTS), "lm-events")
    rest = events.filter("kind = 'word'").select("rid", "train", "word", "context").join(table, "word", "left")
    sign = (F.col("sign") + FIRST + TOP).cast("int")
    rest = written_table(rest.select("rid", "train", "c", "sign", (F.col("context") * CLASSES + F.when(F.col("c") > FEW, sign).otherwise(RARE)).cast("int").alias("cell")), "lm-words")
    cells = events.filter("kind = 'cell'").select("cell", "n").unionByName(
        rest.filter("train").groupBy("cell").agg(F.count("*").alias("n"))).groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    model = spark.sparkContext.broadcast(fit(cells["cell"].to_numpy(), cells["n"].to_numpy()))

    @F.arrow_udf("struct<base: double, value: double>")
    def valued(c: pa.Array, sign: pa.Array, cell: pa.Array) -> pa.Array:
        k = shared.value
        n = c.fill_null(0).to_numpy(zero_copy_only=False)
        with np.errstate(divide="ignore"):
            share = np.log10(n / np.maximum(1, k.bucket[sign.fill_null(0).to_numpy(zero_copy_only=False)]))
        value = model.value[cell.to_numpy(zero_copy_only=False)] + np.where(n > FEW, share, k.rare[np.minimum(n, FEW)])
        return pa.StructArray.from_arrays([pa.array(k.base(n)), pa.array(value)], ["base", "value"])

    other = rest.select("rid", "c", valued("c", "sign", "cell").alias("v")).groupBy("rid").agg(
        F.sum("v.base").alias("more_base"), F.sum("v.value").alias("more"), F.count("c").alias("more_known"))
    texts = events.filter("kind = 'text'").select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "cells").mapInArrow(
        _text_scores(model), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, value double")
    zero = F.lit(0.0)
    return texts.join(other, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("value") + F.col("within") + F.coalesce("more", zero)).alias("score"))

