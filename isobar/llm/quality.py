"""Quality classifier: ordinal cumulative-link regression on graded ratings [operator 5].

Method: a text's distinct words, and its coarse shape, are hashed to DIM features with one shared weight each; their sum is the
score s. Grades 0..K-1 have ordered thresholds: P(grade <= k) = sigmoid(threshold_k - s). Expected grade and the tail
probability P(grade = K-1) come from the same score; documents with a tail of KEEP or more are kept.

The grade is 0 to 2: one point for quality 1, one for toxic 0. The model is fitted on the driver on a bounded sample:
the labelled documents with the SAMPLE least hashes of their ids (a documented parameter). It is DIM weights, of
fixed size, and goes to the executors. All documents are scored on whole texts.

Labels with a null, or for no document, are left out; repeated labels of a document count as its worst. Of a labelled
document's repeated rows one is fitted on, that with the least features, so the bound on the sample holds. In small
samples a feature must be in LEAST_TEXTS texts, in large ones in one text of TEXTS_FOR_ONE, or it gets no weight. Null text is
empty, and empty texts are scored by their shape alone. Without any label all documents are kept with a tail of 1.
Null ids are scored and kept or dropped like others; repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, slices, table

DIM = 1 << 18
SAMPLE = 20_000
GRADES = 3
#: Texts that a feature must be in, one in so many of the sample and two at least: rarer words tell only of those texts.
TEXTS_FOR_ONE = 2000
LEAST_TEXTS = 2
KEEP = 0.5
ROUNDS, RATE, DECAY = 300, 0.05, 3e-3
#: Runs of marks, which are words too.
RUNS = re.compile(r"[!-/:-@\[-`{-~]{2,}")
#: Words of a text are those between these characters.
MARKS = str.maketrans({c: " " for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\r\n\x0b\x0c"})


def shape(text: str, words: list[str], distinct: int) -> list[str]:
    """Coarse facts of a text as words of their own."""
    n, size = max(1, len(text)), max(1, len(words))
    letters = sum(map(len, words))
    bins = {
        "marks": (n - letters - text.count(" ")) / n,
        "upper": sum(map(str.isupper, words)) / size,
        "digits": sum(map(str.isdigit, words)) / size,
        "new": distinct / size,
        "long": letters / size / 20,
    }
    return [f"\x00{k}{int(20 * v)}" for k, v in bins.items()] + [f"\x00size{len(words).bit_length()}"]


def features(text: str | None) -> np.ndarray:
    """Places of the features of a text, each once."""
    text = text or ""
    words = text.translate(MARKS).split()
    found = {w.lower() for w in words}
    found.update(shape(text, words, len(found)))
    found.update(RUNS.findall(text))
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found), np.int64, len(found)) & (DIM - 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """weights, and thresholds in ascending order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and each k below the last grade."""
        return sigmoid(score[:, None] - self.thresholds)

    def score(self, places: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[p].sum(dtype=np.float64) for p in places])


def likelihood(w: np.ndarray, cuts: np.ndarray, sums: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], grades: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and its gradients by w and by cuts, the first threshold and the steps up from it.

    sums gives each row's score for weights; back adds each row's number to the weights that its score is of.
    """
    score = sums(w)
    edges = np.concatenate([[-np.inf], np.cumsum(cuts), [np.inf]])
    with np.errstate(over="ignore"):
        upper, lower = (1 / (1 + np.exp(np.clip(score - edges[grades + k], -700, 700))) for k in (1, 0))
    likely = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    by_level = np.bincount(grades + 1, -each * du / likely, GRADES + 1) + np.bincount(grades, each * dl / likely, GRADES + 1)
    loss = -(each * np.log(likely)).sum() + DECAY / 2 * (w * w).sum()
    return loss, back(each * (du - dl) / likely) + DECAY * w, np.cumsum(by_level[1:-1][::-1])[::-1]


def fit(places: list[np.ndarray], grades: np.ndarray) -> Ordinal:
    """Maximum likelihood with decayed weights, by Adam over all rows. Rare grades weigh as much as frequent ones' root."""
    if not len(places):
        return Ordinal(np.zeros(DIM, np.float32), np.full(GRADES - 1, -35.0))
    flat, of = np.concatenate(places), np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])
    counts = np.bincount(flat, minlength=DIM)
    use = (counts >= max(LEAST_TEXTS, len(places) // TEXTS_FOR_ONE))[flat]
    flat, of = flat[use], of[use]
    used, flat = np.unique(flat, return_inverse=True)  # weights of features that are used alone
    order = np.argsort(flat, kind="stable")
    rows, firsts = of[order], np.flatnonzero(np.diff(flat[order], prepend=-1))
    filled, starts = np.unique(of, return_index=True)

    def sums(w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places))
        if len(filled):
            out[filled] = np.add.reduceat(w[flat], starts)
        return out

    def back(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[rows], firsts) if len(rows) else np.zeros(0)

    counts = np.bincount(grades, minlength=GRADES)
    each = (np.sqrt(counts.sum() / np.maximum(counts, 1)))[grades]
    each /= each.sum()
    w, cuts = np.zeros(len(used)), np.array([-2.0, *[2.0] * (GRADES - 2)])
    moments = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(GRADES - 1), np.zeros(GRADES - 1)]
    for t in range(1, ROUNDS + 1):
        _, grad, grad_cuts = likelihood(w, np.array([cuts[0], *np.maximum(cuts[1:], 0.05)]), sums, back, grades, each)
        for x, g, m, v in ((w, grad, 0, 1), (cuts, grad_cuts, 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[v] = 0.99 * moments[v] + 0.01 * g * g
            x -= RATE * (moments[m] / (1 - 0.9**t)) / (np.sqrt(moments[v] / (1 - 0.99**t)) + 1e-12 + 1e-7)
    weights = np.zeros(DIM, np.float32)
    weights[used] = w
    return Ordinal(weights, np.cumsum([cuts[0], *np.maximum(cuts[1:], 0.05)]))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labelled documents."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", (F.least(F.greatest("quality", F.lit(0)), F.lit(1)) + F.when(F.col("toxic") > 0, 0).otherwise(1)).cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model of a bounded sample of the labelled documents: the same rows for the same table."""
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(x.as_py()).astype(np.int32).tobytes() for x in batch.column(2)], pa.binary())], names=["doc_id", "grade", "places"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    each = rows.mapInArrow(run, "doc_id long, grade int, places binary").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("places").alias("places"))
    found = each.toArrow().sort_by("doc_id")  # at most a row for each id of the sample
    return fit([np.frombuffer(x.as_py(), np.int32) for x in found.column("places")], found.column("grade").to_numpy())


def rate(df: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """df with __expected and __tail."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    k = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for batch in slices(batches):
            above = own.above(own.score([features(x.as_py()) for x in batch.column(k)])).round(6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(1)), pa.array(above[:, -1])], names=[*batch.schema.names, "__expected", "__tail"])

    columns = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return df.mapInArrow(run, f"{columns}, __expected double, __tail double")


def select(df: DataFrame, labels: DataFrame, documents: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of df that the classifier keeps. documents: those that labels tell of, df itself by default."""
    return rate(df, train(df if documents is None else documents, labels)).where(F.col("__tail") >= keep).drop("__expected", "__tail")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    rated = rate(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", F.col("__expected").alias("expected_grade"), F.col("__tail").alias("p_top"), (F.col("__tail") >= KEEP).alias("kept"))
