"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 3-grams of the lower-cased text. Document frequencies come from
every training row (partial sums of a fixed-size vector, merged by feature). The weights are
fitted by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded
sample of the training rows (whole texts, counted by the workers), spread evenly over the
languages; most weights end at zero. A second, disjoint part of the sample sets the temperature
that calibrates the scores: by whole texts, which are easy, and by short pieces of them, which are
not, with a prior that holds the temperature near 1 where the sample says nothing. Prediction
broadcasts the weights, whose size is fixed by BUCKETS and the number of languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix

BUCKETS = 1 << 14
#: Rows of each language that may train the weights; as many again, by a quarter, calibrate.
TRAIN_ROWS = 600
EPOCHS = 4
ALPHA, BETA = 0.5, 1.0
L1, L2 = 0.5, 1e-4
#: Rows of all languages together that train and calibrate at most, however many languages there are.
SAMPLE_ROWS = 12_000
#: Characters of the pieces that calibrate, least and most.
PIECE = (8, 160)
#: Deviation of the logarithm of the temperature that is expected before any row is seen, in rows' worth of log loss.
PRIOR = 1.0
UNDETERMINED = "und"
#: Bounds the weights that are broadcast (8 bytes x BUCKETS each, 64 MB together).
MAX_LANGUAGES = 512


def grams(text: str) -> np.ndarray:
    """Bucket of each 1-, 2- and 3-gram of code points."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    c = np.where(space, np.uint64(32), c) + np.uint64(1)
    shift = np.uint64(21)
    two = c[:-1] << shift | c[1:]
    three = two[:-1] << shift | c[2:] if len(c) > 2 else c[:0]
    return (mix(np.concatenate((c, two, three))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def term_counts(text: str) -> np.ndarray:
    """Counts of the features over the whole text, in pieces of bounded size."""
    total = np.zeros(BUCKETS, np.int64)
    step = 1 << 18
    for i in range(0, len(text), step):
        total += np.bincount(grams(text[i : i + step + 2 if i + step < len(text) else None]), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # languages x (BUCKETS + 1), the last for the bias
    temperature: float


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the unit-length TF-IDF vector, bias included."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt(x @ x)
    return np.append(at, BUCKETS), np.append(x / norm if norm else x, 1.0)


def fit_ftrl(vectors, labels: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates and elastic-net penalties."""
    z = np.zeros((n_classes, BUCKETS + 1))
    n = np.zeros((n_classes, BUCKETS + 1))
    w = np.zeros((n_classes, BUCKETS + 1))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            at, x = vectors[i]
            zi, ni = z[:, at], n[:, at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            s = wi @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = np.outer(p, x)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[:, at] = zi + g - sigma * wi
            n[:, at] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss and prior, by golden-section search over its logarithm."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).sum() + 0.5 * (t / PRIOR) ** 2)

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(60):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def _document_frequencies(batches):
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            total += term_counts(text) > 0
            rows += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])


COUNTS = "lang string, order long, piece boolean, buckets binary, counts binary"


def piece_of(text: str, order: int) -> str:
    """A short stretch of the text; where and how long follows from the row's number."""
    least, most = PIECE
    length = least + order % (most - least + 1)
    start = (order >> 16) % max(1, len(text) - length + 1)
    return text[start : start + length]


def _count_rows(batches):
    """The features of whole texts and of a piece of each with their counts, the features in ascending order."""
    for batch in batches:
        orders = batch.column("order").to_pylist()
        texts = batch.column("text").to_pylist()
        found = [term_counts(t) for t in texts] + [term_counts(piece_of(t, o)) for t, o in zip(texts, orders, strict=True)]
        at = [np.flatnonzero(c) for c in found]
        langs, n = batch.column("lang").to_pylist(), len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs * 2, pa.string()), pa.array(orders * 2, pa.int64()), pa.array([False] * n + [True] * n), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.uint32).tobytes() for c, a in zip(found, at, strict=True)], pa.binary())],
            names=[c.split()[0] for c in COUNTS.split(", ")],
        )


def _row_vector(row: dict, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, np.int64)
    counts[np.frombuffer(row["buckets"], np.uint16)] = np.frombuffer(row["counts"], np.uint32)
    return vector(counts, idf)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on the rows of docs (text, lang) that are not held out; None if there are none."""
    spark = docs.sparkSession
    common.prepare(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    count = known.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(count["bucket"].to_pylist(), count["n"].to_pylist(), strict=True))
    if not df.get(-1):
        return None
    idf = np.zeros(BUCKETS)
    for bucket, n in df.items():
        if bucket >= 0:
            idf[bucket] = np.log((1 + df[-1]) / (1 + n)) + 1
    by_lang = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"{len(by_lang)} languages; the weights are bounded to {MAX_LANGUAGES}")
    train_rows = max(8, min(train_rows, SAMPLE_ROWS // max(1, len(by_lang))))
    # a share of each language's rows by the hash of their id, bounded below
    share = F.lit(0.0)
    for lang, n in by_lang.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.6 * train_rows / n)).otherwise(share)
    drawn = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1e6) < share
    rows = known.where(drawn).select("text", "lang", F.xxhash64("doc_id", "text", F.lit(12)).alias("order")).mapInArrow(_count_rows, COUNTS)
    # the bound takes the rows of least hash, whatever the plan; it holds twice what is expected
    rows = rows.orderBy("order", "lang", "piece", "buckets", "counts").limit(int(4 * train_rows * len(by_lang))).toArrow().to_pylist()
    languages = tuple(sorted(by_lang))
    taken = dict.fromkeys(languages, 0)
    train, rest = [], []
    for r in rows:
        if not r["piece"]:
            taken[r["lang"]] += 1
        if taken[r["lang"]] <= 1.25 * train_rows:
            calibrates = taken[r["lang"]] % 5 == 0
            if calibrates or not r["piece"]:
                (rest if calibrates else train).append((_row_vector(r, idf), languages.index(r["lang"])))
    weights = fit_ftrl([v for v, _ in train], np.array([y for _, y in train], int), len(languages))
    scores = np.array([weights[:, at] @ x for (at, x), _ in rest]).reshape(len(rest), len(languages))
    return Model(languages, idf, weights, calibrate(scores, np.array([y for _, y in rest], int)))


def classify(text: str | None, model: Model | None) -> tuple[str, float]:
    """The language and its calibrated probability; `und` and 0 without a letter or a model."""
    if model is None or not text or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0
    at, x = vector(term_counts(text), model.idf)
    s = model.weights[:, at] @ x / model.temperature
    p = np.exp(s - s.max())
    best = int(p.argmax())
    return model.languages[best], float(p[best] / p.sum())


def _predict(shared):
    def run(batches):
        model = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            out = [classify(t, model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score; fits a model if none is given.

    A text that is null or has no letter is `und` with score 0, and so is every text where no
    labelled row can be learned from. Very long texts are read whole; of languages with equal
    scores the first by name is taken. Rows with a null doc_id count as held out. Repeated rows
    are predicted alike; an empty table gives an empty result; extra columns are ignored.
    """
    common.prepare(docs.sparkSession)
    model = model or fit(docs)
    # plain arrays: workers without this package could not read an instance of its class
    plain = None if model is None else (model.languages, model.idf, model.weights, model.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    rows = common.id_text(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
