"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators say whether a text holds a byte n-gram (N bytes, hashed into 2 ** DIM_BITS buckets), or a word n-gram of repetition (a
word that equals the one before it, twice in a row, and four times). Each is scaled by its class log-count ratio; texts are
brought to length one; a linear hinge-loss model is fitted by dual coordinate descent. Margins become scores by a logistic curve
fitted on the margins of models that haven't seen the text (two folds).

The model is fitted on at most FIT_ROWS labelled rows, those with the least hash of doc_id among the rows that may be learned from;
their features come to the driver, at most 2 ** DIM_BITS numbers each. Every whole text is scored, in one pass without a shuffle.

Null and empty texts have no indicators and get the score of the intercept. Labels that aren't 0 or 1, or have no document, teach
nothing; of repeated labels of a doc_id the least counts. With one class only the score is its smoothed share; without labels 0.5.
A null doc_id is never held out. Repeated doc_ids are scored one by one. Other columns are not read.
"""

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siderea.llm.common import SPACE, one_row_per_id, read_table, tune

N = 4
DIM_BITS = 18
FIT_ROWS = 4000
THRESHOLD = 0.7
_EXTRA = 3  # buckets of repetition
_BREAKS = bytes.maketrans(SPACE, b" " * len(SPACE))


def indicators(text: bytes, last: np.ndarray) -> np.ndarray:
    """Buckets that a text sets, each once. last: scratch of 2 ** DIM_BITS longs, whatever is in it."""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    found = np.zeros(0, np.int64)
    if len(a) >= N:
        gram = a[: len(a) - N + 1].copy()
        for i in range(1, N):
            gram = gram << np.uint32(8) | a[i : len(a) - N + 1 + i]
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)
        place = np.arange(len(bucket))
        last[bucket] = place  # the last of equal ones stays
        found = bucket[last[bucket] == place].astype(np.int64)
    words = text.translate(_BREAKS).split()
    same = list(map(eq, words, words[1:]))
    if True in same:
        run = bytes(same)
        more = [i for i, k in enumerate((1, 2, 4)) if b"\x01" * k in run]
        found = np.concatenate([found, (1 << DIM_BITS) + np.array(more)])
    return found


def ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    size = (1 << DIM_BITS) + _EXTRA
    p, q = np.full(size, alpha), np.full(size, alpha)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights (ratios included) and intercept of the hinge-loss model, by dual coordinate descent."""
    rnd = np.random.default_rng(seed)
    xs = [r[f] / max(np.sqrt((r[f] ** 2).sum()), 1e-12) for f in rows]
    w, b, a = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    cost = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(rounds):
        for i in rnd.permutation(len(rows)):
            f, x = rows[i], xs[i]
            g = y[i] * (w[f] @ x + b) - 1
            new = min(max(a[i] - g / 2.0, 0.0), cost[i])  # the squared length is 1, and 1 for the intercept
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[f] += step * x
                b += step
                a[i] = new
    return w, b


def margin(f: np.ndarray, r: np.ndarray, w: np.ndarray, b: float) -> float:
    x = r[f]
    return float(w[f] @ x) / max(float(np.sqrt(x @ x)), 1e-12) + b if len(f) else b


def logistic(m: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the curve through margins, by Newton steps, a little drawn to zero."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    s, o = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(s * m + o, -35, 35)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * s, (p - t).sum() + 1e-3 * o])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        s, o = s - d[0], o - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(s, 1e-6), o


class Model:
    """r, w, b and the curve's s, o; or a constant score."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.constant = None
        if not len(rows) or len(set(y.tolist())) < 2:
            self.constant = (float((y > 0).sum()) + 1) / (len(y) + 2)
            return
        margins = np.zeros(len(y))
        for fold in (0, 1):
            inside = np.arange(len(y)) % 2 == fold
            train, yt = [x for x, k in zip(rows, inside, strict=True) if not k], y[~inside]
            r = ratios(train, yt)
            w, b = descend(train, yt, r)
            margins[inside] = [margin(x, r, w, b) for x, k in zip(rows, inside, strict=True) if k]
        self.s, self.o = logistic(margins, y)
        self.r = ratios(rows, y)
        self.w, self.b = descend(rows, y, self.r)

    def score(self, f: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        z = self.s * margin(f, self.r, self.w, self.b) + self.o
        return float(1 / (1 + np.exp(-min(max(z, -35), 35))))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int = FIT_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, quality), may_learn: on doc_id."""
    tune(docs.sparkSession)
    known = one_row_per_id(labels.select("doc_id", "quality"), "doc_id").filter(F.col("quality").isin(0, 1) & may_learn)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` rows of two numbers
    order = [F.xxhash64("doc_id", "text"), F.col("doc_id")]
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(*order).limit(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << DIM_BITS, np.int64)
        for b in batches:
            fs = [indicators(t or b"", last).astype("<i4").tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(fs, pa.binary())], ["doc_id", "quality", "f"])

    kind = labels.schema["quality"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    got = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(features, f"doc_id {kind[1]}, quality {kind[0]}, f binary").toArrow()
    taken = sorted(zip(got["doc_id"].to_pylist(), got["f"].to_pylist(), got["quality"].to_pylist(), strict=True))
    return Model([np.frombuffer(f, "<i4") for _, f, _ in taken], np.array([1.0 if q else -1.0 for *_, q in taken]))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep's columns and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << DIM_BITS, np.int64)
        m = shared.value
        for b in batches:
            s = [m.score(indicators(t or b"", last)) for t in b.column("_scored").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def score_column(spark: SparkSession, model: Model):
    """The score as a function of a text column, for filters that keep all other columns in the JVM."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        last = np.zeros(1 << DIM_BITS, np.int64)
        m = shared.value
        for t in texts:
            yield pd.Series([m.score(indicators((x or "").encode(), last)) for x in t], dtype="float64")

    return score


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
