"""Toxicity as severity grades: cumulative-link ordinal regression on sparse text features.

Features are words (A-Z lower-cased runs of ASCII letters, digits and non-ASCII bytes) and
word beginnings of five to eight bytes, all as 64-bit hashes. The ones that tell toxic from
clean labelled texts are kept; each enters by presence and by its share of the words. One
weight vector serves all thresholds: P(grade >= k) = logistic(w.x - t[k]), t ascending. The
expected severity is the sum of these probabilities.

Labels are 0 or 1. Toxic texts are graded 1 to ``GRADES`` by how large a share of their words
the kept features are, in equal parts. Training takes ``FIT_ROWS`` labelled rows of each
class by hash order of the id (a bound); whole texts are read in training and scoring.

Defined results: null or empty text has no features and the severity of the intercepts.
Without labelled rows of both classes nothing is toxic: severity 0. Rows that repeat an id are
scored by their own texts; labels that contradict each other are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm import words as W
from brickyard.llm.common import REPEATS, at_most, fresh, stage

FIT_ROWS = 4000       # labelled rows of each class
GRADES = 3
FEATURES = 600        # kept at most
BEGINNINGS = (5, 6, 7, 8)
REJECT = 0.5          # probability of grade 1 or more

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, row) of every word, then of the beginnings of each length, with words per row."""
    low = W.LOWER[data]
    start, end, row = W.spans(low, offsets, _BREAKS)
    count = np.bincount(row, minlength=len(offsets) - 1)
    yield W.hashes(low, start, end), row, count
    for k in BEGINNINGS:
        long = end - start >= k
        mark = W.mix(np.full(1, k, np.uint64))
        yield W.hashes(low, start[long], start[long] + k) ^ mark, row[long], count


@dataclass
class Model:
    """Kept features (sorted hashes), weights for presence and share, thresholds."""

    known: np.ndarray
    presence: np.ndarray
    share: np.ndarray
    thresholds: np.ndarray

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Counts of the kept features in each text, divided by its words."""
        out = []
        table = np.zeros(1 << 16, bool)
        table[self.known & np.uint64(0xFFFF)] = True
        for _, data, offsets in W.texts(column):
            m = np.zeros((len(offsets) - 1, len(self.known)), np.float32)
            for h, row, count in features(data, offsets):
                may = np.flatnonzero(table[h & np.uint64(0xFFFF)])
                if not len(may):
                    continue
                at = np.minimum(np.searchsorted(self.known, h[may]), len(self.known) - 1)
                hit = self.known[at] == h[may]
                np.add.at(m, (row[may][hit], at[hit]), 1)
            out.append(m / np.maximum(1, count)[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.known)), np.float32)

    def above(self, share: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each row."""
        raw = inputs(share) @ np.concatenate((self.presence, self.share))
        return 1 / (1 + np.exp(-np.clip(raw[:, None] - self.thresholds[None, :], -30, 30)))


def inputs(share: np.ndarray) -> np.ndarray:
    """Presence and damped share of each feature."""
    return np.concatenate(((share > 0).astype(np.float32), np.log1p(100 * share)), axis=1)


def ordinal(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 400, ridge: float = 2e-4
            ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by Adam on all rows.

    Thresholds are a first one and positive gaps, so they cannot cross.
    """
    n, p = x.shape
    w, t = np.zeros(p), np.concatenate(([2.0], np.zeros(grades - 1)))
    first, second = np.zeros(p + grades), np.zeros(p + grades)
    for step in range(1, steps + 1):
        gaps = np.exp(t[1:])
        cuts = t[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        up = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - cuts[None, :], -30, 30)))
        full = np.concatenate((np.ones((n, 1)), up, np.zeros((n, 1))), axis=1)
        rows = np.arange(n)
        lik = np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)
        slope = full * (1 - full)
        d_raw = (slope[rows, y] - slope[rows, y + 1]) / lik
        d_cut = np.zeros((n, grades + 2))
        d_cut[rows, y] -= slope[rows, y] / lik
        d_cut[rows, y + 1] += slope[rows, y + 1] / lik
        by_cut = d_cut[:, 1:-1].mean(0)
        later = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate((x.T @ d_raw / n - ridge * w, [later[0]], later[1:] * gaps))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w += move[:p]
        t += move[p:]
    return w, t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model | None:
    """A model from labelled rows; None where a class has none."""
    clean = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).filter("_y = _z"))
    order = [F.xxhash64("_id"), "_id"]
    picked = [clean.filter(F.col("_y") == y).orderBy(*order).limit(FIT_ROWS).select("_id", "_y")
              for y in (0, 1)]
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = stage(at_most(own.join(F.broadcast(picked[0].unionByName(picked[1])), "_id"), REPEATS), "toxicity-rows")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data, offsets in W.texts(batch.column("_text")):
                found = [[] for _ in range(len(offsets) - 1)]
                for h, row, _ in features(data, offsets):
                    cut = np.searchsorted(row, np.arange(len(offsets)))
                    for r, f in enumerate(found):
                        f.append(h[cut[r]:cut[r + 1]])
                out += [np.unique(np.concatenate(f)).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(out, pa.binary())],
                                             names=["y", "features"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in distinct(batches):
            y = batch.column("y").to_numpy()
            sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in batch.column("features")]
            for label in (0, 1):
                these = [s for s, v in zip(sets, y) if v == label]
                if these:
                    h, n = np.unique(np.concatenate(these), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(np.full(len(h), label, np.int32)),
                         pa.array(n)], names=["h", "y", "n"])

    kind = rows.schema["_y"].dataType.simpleString()
    size = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(size) < 2:
        return None
    p1 = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    p0 = F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    n1, n0 = size[1], size[0]
    rate1, rate0 = (F.col("p1") + 0.5) / (n1 + 1), (F.col("p0") + 0.5) / (n0 + 1)
    # Signed likelihood gain of knowing the feature, for features that speak for toxicity.
    gain = F.col("p1") * F.log(rate1 / rate0)
    kept = (rows.select("_text", "_y").mapInArrow(counted, "h bigint, y int, n bigint")
            .groupBy("h").agg(p1.alias("p1"), p0.alias("p0"))
            .filter((F.col("p1") >= 3) & (rate1 > 3 * rate0))
            .orderBy(gain.desc(), "h").limit(FEATURES).select("h").toPandas())
    known = np.sort(kept["h"].to_numpy(np.int64).view(np.uint64))
    if not len(known):
        return None
    empty = np.zeros(len(known))
    model = Model(known, empty, empty, np.zeros(GRADES))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.matrix(batch.column("_text")).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"), pa.array([r.tobytes() for r in m], pa.binary())],
                names=["id", "y", "m"])

    id_kind = rows.schema["_id"].dataType.simpleString()
    data = (rows.select("_id", "_text", "_y").mapInArrow(shares, f"id {id_kind}, y {kind}, m binary")
            .toPandas().sort_values(["id", "m"]))
    share = np.stack([np.frombuffer(m, "<f4") for m in data["m"]])
    y = data["y"].to_numpy(int)
    total = share.sum(1)
    cuts = np.quantile(total[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, total), 0)
    w, model.thresholds = ordinal(inputs(share).astype(float), grade, GRADES)
    model.presence, model.share = w[:len(known)], w[len(known):]
    # The classes were drawn evenly up to their bounds; the thresholds follow their true shares.
    toxic = clean.agg(F.avg("_y")).first()[0]
    model.thresholds = model.thresholds + np.log(n1 / n0) - np.log(toxic / (1 - toxic))
    return model


def scored(docs: DataFrame, model: Model | None, text_col: str, name: str) -> DataFrame:
    """``docs`` with the struct ``name`` of severity (expected grade), grade and p_toxic."""
    if model is None:
        none = F.struct(F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"))
        return docs.withColumn(name, none)

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            up = model.above(model.matrix(pa.array(text, pa.string(), from_pandas=True)))
            full = np.concatenate((np.ones((len(up), 1)), up, np.zeros((len(up), 1))), axis=1)
            yield pd.DataFrame({"severity": up.sum(1), "grade": (full[:, :-1] - full[:, 1:]).argmax(1)
                                .astype(np.int32), "p_toxic": up[:, 0]})

    return docs.withColumn(name, score(F.col(text_col)))


def severity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, severity, grade (most likely one), p_toxic, rejected."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return (scored(rows, model, "text", "s").select("doc_id", "s.*")
            .withColumn("rejected", F.col("p_toxic") >= reject))


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text",
                  reject: float = REJECT) -> DataFrame:
    """``docs`` without rejected rows; all columns as they are."""
    name = fresh(docs, "_toxicity")
    return (scored(docs, model, text_col, name).filter(F.col(name)["p_toxic"] < reject)
            .select(docs.columns))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return severity(docs, fit(docs, labels))
