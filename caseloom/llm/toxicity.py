"""Toxicity from subword bags: averaged n-gram embeddings and a linear softmax, trained together in NumPy.

A word, a run of letters and digits, is the mean of the vectors of its character n-grams; a text is the mean of its
words. So an unseen spelling shares most vectors with the spellings seen. Embeddings and softmax are fitted together by
Adagrad on a bounded sample of labelled rows (`SAMPLE` rows a label, texts of at most `SAMPLE_BYTES`). As the score is
linear in the averaged vectors, scoring needs one number an n-gram bucket, a table of fixed size that is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix, release, run_hashes

BUCKETS = 1 << 20
ORDERS = (3, 4)
DIM = 8
SAMPLE = {1: 2000, 0: 4000}  # labelled rows used to fit
SAMPLE_BYTES = 32768
LEAST_ROWS = 5  # of the sample that must have a bucket; others keep a vector of 0
EPOCHS, BATCH, RATE, SCALE = 6, 64, 0.1, 100.0
CHARS = 1 << 18
ROWS = 1000  # texts scored at a time


def _word_symbols(points: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits."""
    low = np.fromiter((chr(i).isalnum() for i in range(0x600)), bool, 0x600)
    out = np.zeros(len(points), bool)
    near = points < 0x600
    out[near] = low[points[near]]
    if not near.all():
        far, place = np.unique(points[~near], return_inverse=True)
        out[~near] = np.fromiter((chr(i).isalnum() for i in far), bool, len(far))[place]
    return out


def _subwords(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words (with a border on both sides), and the word of each."""
    sizes = ends - starts + 2
    stops = np.cumsum(sizes)
    symbols = np.empty(int(stops[-1]) if len(stops) else 0, np.uint64)
    firsts = stops - sizes
    inner = np.ones(len(symbols), bool)
    inner[firsts] = inner[stops - 1] = False
    symbols[firsts], symbols[stops - 1] = 1, 2
    symbols[inner] = points[np.arange(inner.sum()) + np.repeat(starts - np.cumsum(sizes - 2) + sizes - 2, sizes - 2)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out, who = [], []
    for n in ORDERS:
        if len(symbols) < n:
            continue
        last = len(symbols) - n + 1
        value = np.full(last, n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + symbols[i:i + last]
        within = owner[:last] == owner[n - 1:]
        out.append((mix(value[within]) % np.uint64(BUCKETS)).astype(np.int64))
        who.append(owner[:last][within])
    return (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _parts(texts: list[str], limit: int = CHARS):
    """Runs of (number of the text, part), cut between words at about `limit` symbols."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = at + limit
            while stop < len(text) and text[stop].isalnum():
                stop += 1
            held.append((i, text[at:stop]))
            size += len(held[-1][1])
            at = stop
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def bags(texts: list[str]):
    """Per run of texts: (text of each token, word of each token, buckets, word of each bucket, words)."""
    for held in _parts(texts):
        lowered = [part.lower() for _, part in held]
        points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _word_symbols(points)
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes = run_hashes(lambda a, b: mix(points[a:b].astype(np.uint64)), starts, ends)
        _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        bucket, owner = _subwords(points, starts[first], ends[first])
        bounds = np.cumsum([0, *[len(x) + 1 for x in lowered]])
        text = np.array([i for i, _ in held], np.int64)[np.searchsorted(bounds, starts, "right") - 1]
        yield text, word, bucket, owner, len(first)


def rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as sparse rows over buckets: (offsets of the texts, buckets, weights); weights of a text sum to 1."""
    sizes, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    # A word has fewer than two n-grams a letter. Written once, never copied; what stays unwritten takes no memory.
    most, have = 2 * sum(map(len, texts)), 0
    buckets, weights = np.empty(most, np.int32), np.empty(most, np.float32)
    for text, word, bucket, owner, n in bags(texts):
        total += np.bincount(text, minlength=len(texts))
        own = np.bincount(owner, minlength=n)
        starts = np.concatenate([[0], np.cumsum(own)])
        order = np.argsort(owner, kind="stable")
        pair, times = np.unique(text * n + word, return_counts=True)
        w = pair % n
        grams = own[w]
        at = order[np.arange(grams.sum()) + np.repeat(starts[w] - np.cumsum(grams) + grams, grams)]
        key, place = np.unique(np.repeat(pair // n, grams) * BUCKETS + bucket[at], return_inverse=True)
        sizes += np.bincount(key // BUCKETS, minlength=len(texts))
        buckets[have:have + len(key)] = key % BUCKETS
        weights[have:have + len(key)] = np.bincount(place, weights=np.repeat(times / np.maximum(1, own[w]), grams), minlength=len(key))
        have += len(key)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for i, words in enumerate(total.astype(np.float32)):
        weights[offsets[i]:offsets[i + 1]] /= max(words, np.float32(1))
    return offsets, buckets[:have], weights[:have]


@dataclass
class Model:
    bucket: np.ndarray  # what each n-gram bucket adds to the log-odds of the mean
    bias: float


def train(offsets: np.ndarray, bucket: np.ndarray, weight: np.ndarray, label: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Fit embeddings and softmax to sparse rows, and the scale of the scores to every fifth row, left out of that.

    One dimension starts at the log-ratio of a bucket's shares of rows in the two labels, the others at random; all are
    trained. `prior` is the share of label 1 among all labelled rows. One label only gives a constant score.
    """
    n = len(label)
    if not n or label.min() == label.max():
        return Model(np.zeros(BUCKETS, np.float32), _log_odds(prior))
    rng = np.random.default_rng(seed)
    times = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(bucket), CHARS):
        times += np.bincount(bucket[at:at + CHARS], minlength=BUCKETS)
    known = times >= LEAST_ROWS
    number = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)
    del times

    def taken(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows: (place in the batch, number of the bucket, weight) of each entry of a known bucket."""
        sizes = offsets[batch + 1] - offsets[batch]
        at = np.arange(sizes.sum()) + np.repeat(offsets[batch] - np.cumsum(sizes) + sizes, sizes)
        b, row = number[bucket[at]], np.repeat(np.arange(len(batch)), sizes)
        use = b >= 0
        return row[use], b[use], weight[at[use]]

    fitted = rng.permutation(n) % 5 > 0
    if len(set(label[fitted])) < 2:
        fitted[:] = True
    vectors, out, bias = _start(taken, label, known, fitted, rng)
    seen = np.full(len(vectors), 1e-6, np.float32)
    balance = np.where(label == 1, 0.5 / (label[fitted] == 1).mean(), 0.5 / (label[fitted] == 0).mean())
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(np.flatnonzero(fitted))
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            row, b, w = taken(batch)
            w *= SCALE
            picked = vectors[b]
            hidden = np.stack([np.bincount(row, weights=picked[:, d] * w, minlength=len(batch)) for d in range(DIM)], 1)
            logit = hidden @ out + bias
            error = np.exp(logit - logit.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(batch)), label[batch]] -= 1
            error *= balance[batch][:, None]
            back = error @ out.T
            used, place = np.unique(b, return_inverse=True)
            slope = np.stack([np.bincount(place, weights=back[row, d] * w, minlength=len(used)) for d in range(DIM)], 1)
            seen[used] += (slope ** 2).sum(1)
            vectors[used] -= rate * slope / np.sqrt(seen[used])[:, None]
            out -= 0.02 * rate * (hidden.T @ error) / len(batch) / max(1.0, np.abs(hidden).max())
            bias -= 0.05 * rate * error.sum(0)
    values = vectors @ (out[:, 1] - out[:, 0]) * SCALE
    score = _sums(taken, values, n) + bias[1] - bias[0]
    slope, shift = _calibrated(score[~fitted], label[~fitted], prior)
    table = np.zeros(BUCKETS, np.float32)
    table[known] = values * slope
    return Model(table, float((bias[1] - bias[0]) * slope + shift))


def _batches(n: int):
    return (np.arange(at, min(n, at + BATCH)) for at in range(0, n, BATCH))


def _sums(taken, values: np.ndarray, n: int) -> np.ndarray:
    """Of each row, the values of its buckets by weight."""
    found = [np.zeros(0)]
    for batch in _batches(n):
        row, b, w = taken(batch)
        found.append(np.bincount(row, weights=w * values[b], minlength=len(batch)))
    return np.concatenate(found)


def _start(taken, label, known, fitted, rng):
    """First embeddings of the known buckets, softmax weights and bias."""
    n, size = len(label), int(known.sum())
    rows_of = [max(1, int((label[fitted] == y).sum())) for y in (0, 1)]
    share = np.zeros((2, size))
    for batch in _batches(n):
        row, b, _ = taken(batch)
        for y in (0, 1):
            np.add.at(share[y], b[(fitted[batch] & (label[batch] == y))[row]], 1)
    share /= np.array(rows_of)[:, None]
    few = 0.5 / min(rows_of)
    ratio = np.log((share[1] + few) / (share[0] + few))
    # All buckets draw, so that a bucket's vector does not depend on which others are known.
    drawn = (rng.standard_normal((CHARS, DIM))[known[at:at + CHARS]] for at in range(0, BUCKETS, CHARS))
    vectors = np.concatenate([(x * 0.01).astype(np.float32) for x in drawn])
    vectors[:, 0] = ratio
    out = rng.standard_normal((DIM, 2)) * 0.3
    out[0] = (-0.5, 0.5)
    first = _sums(taken, ratio, n) * SCALE
    middle = (first[fitted & (label == 1)].mean() + first[fitted & (label == 0)].mean()) / 2
    return vectors, out, np.array([middle / 2, -middle / 2])


def _calibrated(score: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the label to the score, rows weighted to `prior`, held towards 1 and 0."""
    slope, shift = 1.0, 0.0
    if len(set(label)) < 2:
        return slope, _log_odds(prior)
    weight = np.where(label == 1, prior / (label == 1).mean(), (1 - prior) / (label == 0).mean())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -50, 50)))
        x = np.stack([score, np.ones_like(score)])
        pull = np.array([slope - 1, shift * 0.1])
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + np.diag([1.0, 0.1]), x @ (weight * (p - label)) + pull)
        slope, shift = slope - np.clip(step[0], -0.3, 0.3), shift - np.clip(step[1], -1, 1)
    return max(0.05, float(slope)), float(shift)


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 of each text; a null text or one without words has that of the bias."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for text, word, bucket, owner, n in bags([t or "" for t in texts]):
        value = np.bincount(owner, weights=model.bucket[bucket], minlength=n) / np.maximum(1, np.bincount(owner, minlength=n))
        total += np.bincount(text, weights=value[word], minlength=len(texts))
        count += np.bincount(text, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, count) + model.bias, -50, 50)))


def sample(rows_labelled: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled ids, rows to fit on): at most `SAMPLE` ids a label, first by a hash of the id, with their texts.

    An id that is labelled more than once counts as 1 if any of its labels is; null ids and labels are passed over.
    """
    labelled = rows_labelled.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for label, most in SAMPLE.items():
        own = labelled.filter(F.col("label") == label).orderBy(*order).limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    # The ids are bounded by SAMPLE, so they may be broadcast.
    return labelled, docs.filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id").orderBy("label", *order)


def fit(rows_labelled: DataFrame, docs: DataFrame) -> Model:
    """Learn from `rows_labelled` (doc_id, label 0 or 1) and the texts of `docs` (doc_id, text).

    Without labelled rows, or with one label only, all texts get the same score.
    """
    labelled, chosen = sample(rows_labelled, docs)
    prior = labelled.agg(F.avg(F.col("label").cast("double"))).first()[0]
    got = chosen.select("text", "label").toArrow()
    label, texts = np.array(got["label"].to_pylist(), np.int64), got["text"].to_pylist()
    del got
    held = rows(texts)
    del texts
    release()  # the driver needs neither texts nor tables of hashes while it trains, and nothing but the model afterwards
    model = train(*held, label, 0.0 if prior is None else prior)
    del held
    release()
    return model


def scored(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column with the probability of label 1 of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        found = [np.zeros(0), *[score_texts(shared.value, column.slice(at, ROWS).to_pylist()) for at in range(0, len(column), ROWS)]]
        release()
        return pa.array(np.concatenate(found))

    return score(F.col(f"`{text}`").cast("string"))
