"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all labelled rows in the tasks (one small matrix a task) and sums them in Spark. The matrix of
log-probabilities, languages x buckets, is broadcast: its size depends on the number of languages only, which is checked.
Scoring sums matrix entries over the n-grams of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import release

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 500  # the broadcast matrix stays under 500 x 32768 x 4 bytes = 66 MB
UNKNOWN = "und"
CHARS = 1 << 18  # characters worked on at a time
ROWS = 1000  # texts scored at a time
LANGS_HELD = 32
FAR = 12.0  # deviations below the mean from which a text is not in its likeliest language
LEAST_BETWEEN, LEAST_WITHIN = 0.1, 2.5  # least deviations of texts, and of a letter's log-probability


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    low = np.fromiter((chr(i).isalpha() for i in range(0x600)), bool, 0x600)
    out = np.zeros(len(points), bool)
    near = points < 0x600
    out[near] = low[points[near]]
    if not near.all():
        far, place = np.unique(points[~near], return_inverse=True)
        out[~near] = np.fromiter((chr(i).isalpha() for i in far), bool, len(far))[place]
    return out


def chunks(texts: list[str], limit: int = CHARS):
    """Lists of texts of about `limit` characters; a longer text comes in parts, as (number of the text, part)."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), limit):
            held.append((i, text[at:at + limit]))
            size += len(held[-1][1])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the lower-cased texts, and the text each of them is from.

    What is not a letter counts as one border symbol; n-grams of borders only are left out.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])  # of each symbol after the first border
    symbol = np.where(letters(points), points, 0).astype(np.uint64)
    n = len(owner)
    before, here, after = symbol[:n], symbol[1:n + 1], symbol[2:n + 2]
    kept = here > 0
    a, b, c, owner = before[kept], here[kept], after[kept], owner[kept]
    prime, far, near = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x1F123BB5), np.uint64(0x2545F491)
    grams = {1: b, 2: a * far + b, 3: (a * far + b) * near + c}
    out = [(grams[n] + np.uint64(n << 60)) * prime for n in ORDERS]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([x >> shift for x in out]).astype(np.int64), np.tile(owner, len(out))


@dataclass
class Model:
    languages: list[str]
    log_probs: np.ndarray  # languages x buckets
    priors: np.ndarray


def _count(parts):
    counts: dict[str, np.ndarray] = {}

    def flush():
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
        counts.clear()

    for part in parts:
        langs, texts = part.column(0), part.column(1)
        for lang in pc.unique(langs).to_pylist():
            own = texts.filter(pc.equal(langs, lang))
            if lang not in counts and len(counts) >= LANGS_HELD:
                yield from flush()
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for at in range(0, len(own), ROWS):
                for held in chunks(own.slice(at, ROWS).to_pylist()):
                    total += np.bincount(ngrams([t for _, t in held])[0], minlength=BUCKETS)
    yield from flush()


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a text and a language; rows that lack either are passed over.

    No such row gives a model without languages, which predicts `und` for everything.
    """
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(docs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(docs)
    matrix = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {x: i for i, x in enumerate(languages)}
    matrix[counts["lang"].map(place).to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    matrix /= matrix.sum(1, keepdims=True)
    priors = np.log(np.array([docs[x] for x in languages], float) / max(1, sum(docs.values())))
    return Model(languages, np.log(matrix).astype(np.float32), priors)


def _scored(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Likeliest language, its posterior, letters, and mean log-probability of an n-gram under it (without prior)."""
    n, k = len(texts), len(model.languages)
    total, seen = np.tile(model.priors, (n, 1)), np.zeros(n, np.int64)
    for held in chunks([t or "" for t in texts]):
        bucket, owner = ngrams([t for _, t in held])
        row = np.array([i for i, _ in held])[owner]
        seen += np.bincount(row, minlength=n)
        for j in range(k):
            total[:, j] += np.bincount(row, weights=model.log_probs[j, bucket], minlength=n)
    known = (seen > 0) & (k > 0)
    names, score, mean = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    if k:
        best = total.argmax(1)
        score = np.where(known, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)
        mean = np.where(known, (total[np.arange(n), best] - model.priors[best]) / np.maximum(seen, 1), 0.0)
        names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
    return names, score, seen // len(ORDERS), mean


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    return _scored(model, texts)[:2]


def measured(model: Model, rows: DataFrame, text: str = "text") -> Column:
    """A struct column (lang_pred, score, letters, likeness): as `predicted`, with the number of letters and the mean
    log-probability of an n-gram under the predicted language, which does not saturate as texts grow."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, letters long, likeness double")
    def measure(column: pa.Array) -> pa.Array:
        names, rest = [], [[np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for at in range(0, len(column), ROWS):
            found, *numbers = _scored(shared.value, column.slice(at, ROWS).to_pylist())
            names += found
            for held, x in zip(rest, numbers, strict=True):
                held.append(x)
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), *[pa.array(np.concatenate(x)) for x in rest]], ["lang_pred", "score", "letters", "likeness"])

    return measure(F.col(f"`{text}`").cast("string"))


def usual(measures: DataFrame, lang: str = "lang", measure: str = "m") -> dict[str, tuple[float, float, float]]:
    """Per language (mean, between, within) of the likeness on rows that bear the predicted language.

    The variance of a text's likeness is taken as between**2 + within**2 / letters; both parts follow from the plain mean of
    squared deviations and that weighted by letters. One row a language comes to the driver.
    """
    x, n = F.col(f"{measure}.likeness"), F.col(f"{measure}.letters").cast("double")
    own = measures.filter((F.col(f"`{lang}`") == F.col(f"{measure}.lang_pred")) & (n > 0))
    sums = own.groupBy(F.col(f"{measure}.lang_pred").alias("l")).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(1 / n).alias("r"), F.sum(n * x).alias("nx"), F.sum(n * x * x).alias("nxx"),
        F.sum(x).alias("x"), F.sum(x * x).alias("xx"))
    out = {}
    for r in sums.collect():
        mean = r["nx"] / r["n"]
        plain = r["xx"] / r["k"] - 2 * mean * r["x"] / r["k"] + mean * mean
        weighted = max(0.0, r["nxx"] / r["n"] - mean * mean)
        short, long = r["r"] / r["k"], r["k"] / r["n"]
        within = (plain - weighted) / (short - long) if short > long * 1.001 else 0.0
        within = max(within, LEAST_WITHIN ** 2)
        out[r["l"]] = mean, max(weighted - within * long, LEAST_BETWEEN ** 2) ** 0.5, within ** 0.5
    return out


def is_usual(usual_of: dict[str, tuple[float, float, float]], measure: str = "m") -> Column:
    """Whether a text is as likely in its predicted language as texts of that language are: no more than `FAR` deviations below.

    Other languages, symbols among letters and random letters fall out; a text of few letters needs stronger evidence.
    """
    x, n, name = F.col(f"{measure}.likeness"), F.col(f"{measure}.letters").cast("double"), F.col(f"{measure}.lang_pred")
    case = F.lit(True)
    for lang, (mean, between, within) in usual_of.items():
        case = F.when(name == lang, x >= mean - FAR * F.sqrt(between ** 2 + within ** 2 / n)).otherwise(case)
    return (n > 0) & case


def predicted(model: Model, rows: DataFrame, text: str = "text") -> Column:
    """A struct column (lang_pred, score) for a text column.

    `und` and 0 for a null text or one without a letter; ties go to the language that sorts first. Texts count whole.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for at in range(0, len(column), ROWS):
            found, score = score_texts(shared.value, column.slice(at, ROWS).to_pylist())
            names += found
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return predict(F.col(f"`{text}`").cast("string"))
