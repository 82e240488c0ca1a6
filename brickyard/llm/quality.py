"""Quality by compression: zstandard dictionaries of good and bad text, calibrated.

Two dictionaries are trained on labelled text of each class. A text's blocks are compressed
with both; (bad - good) / (bad + good) of the summed sizes is the normalised compressed-size
difference. A logistic curve, fitted on other labelled rows, turns it into the probability of
label 1. The curve's second input is how far the sizes fall below a quarter of the text: in
text that repeats itself both sizes vanish, and with them their difference. Blocks keep a
dictionary's influence the same along a long text, and whole texts are read.

Bounds: ``DICTIONARY_ROWS`` labelled ids of each class for the dictionaries and
``CALIBRATION_ROWS`` of each for the curve, taken by hash order of the id, ``REPEATS`` rows of
an id at most. A dictionary takes ``BLOCKS`` blocks of a text, spread evenly over all of it; the
curve's inputs are those of whole texts, computed in tasks. Everything else covers all rows.

Defined results: null, empty or white text has difference 0 and gets the curve's value there.
Without labelled rows of both classes every score is the share of good labels (0.5 without
labels). Rows that repeat an id are scored by their own texts; labels that repeat an id count
once, and contradicting ones are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import REPEATS, at_most

DICTIONARY_ROWS = 2000
CALIBRATION_ROWS = 2000
BLOCKS = 10            # of a text, for a dictionary
DICTIONARY_BYTES = 64 << 10
BLOCK = 2048
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Model:
    """Both dictionaries and the curve; picklable."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0)
    center: tuple[float, ...] = (0.0, 0.0)
    shift: float = 0.0

    def sizes(self) -> Sizes:
        return Sizes(self.good, self.bad)

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = (x - np.array(self.center)) @ np.array(self.weights) + self.shift
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


class Sizes:
    """Compressors for both dictionaries, made once per task."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            data = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False,
                                            write_content_size=False, write_dict_id=False)
        self.both = compressor(good), compressor(bad)

    def inputs(self, text: str | None) -> tuple[float, float]:
        """Normalised size difference, and log of the sizes' share below a quarter, or 0."""
        raw = " ".join((text or "").split()).encode()
        if not raw:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(raw[i:i + BLOCK])) for i in range(0, len(raw), BLOCK))
                     for c in self.both)
        return (bad - good) / (bad + good), min(0.0, math.log(2 * (good + bad) / len(raw)))


def _blocks(text: str | None) -> list[bytes]:
    """At most ``BLOCKS`` blocks of a text, evenly spread from its beginning to its end."""
    raw = " ".join((text or "").split()).encode()
    starts = range(0, len(raw), BLOCK)
    some = sorted({round(i) for i in np.linspace(0, len(starts) - 1, min(BLOCKS, len(starts)))})
    return [raw[starts[i]:starts[i] + BLOCK] for i in some]


def _dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[:DICTIONARY_BYTES] or b"\n"


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, centre and shift of a logistic curve by Newton steps, Platt's smoothed targets."""
    center, scale = np.median(x, axis=0), np.where(x.std(0) > 0, x.std(0), 1.0)
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.column_stack(((x - center) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, z.T @ (target - p) - 1e-2 * w), -2, 2)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, center, float(w[-1])


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Dictionaries from folds 1 to 3, the curve from fold 4; fold 0 is never read."""
    clean = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).filter("_y = _z")
             .withColumns({"_fold": fold("_id"), "_order": F.xxhash64("_id")})
             .filter("_fold <> 0"))
    picked = None
    for y in (0, 1):
        for folds, rows in ((F.col("_fold") < 4, DICTIONARY_ROWS), (F.col("_fold") == 4, CALIBRATION_ROWS)):
            some = (clean.filter((F.col("_y") == y) & folds).orderBy("_order", "_id").limit(rows)
                    .select("_id", "_y", (F.col("_fold") == 4).alias("_curve")))
            picked = some if picked is None else picked.unionByName(some)
    rows = at_most(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                   .join(F.broadcast(picked), "_id").filter("_text IS NOT NULL"), REPEATS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"),
                 pa.array([_blocks(t.as_py()) for t in batch.column("_text")], pa.list_(pa.binary()))],
                names=["id", "y", "blocks"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_y")}
    held = (rows.filter("NOT _curve").select("_id", "_y", "_text")
            .mapInArrow(cut, f"id {kinds['_id']}, y {kinds['_y']}, blocks array<binary>").collect())
    held.sort(key=lambda r: (r.id, r.blocks))
    model = Model(*(_dictionary([b for r in held if r.y == y for b in r.blocks]) for y in (1, 0)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for batch in batches:
            x = np.array([sizes.inputs(t.as_py()) for t in batch.column("_text")]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"), batch.column("_curve"), pa.array(x[:, 0]), pa.array(x[:, 1])],
                names=["id", "y", "curve", "x0", "x1"])

    def inputs(some: DataFrame):
        return some.select("_id", "_y", "_curve", "_text").mapInArrow(
            measured, f"id {kinds['_id']}, y {kinds['_y']}, curve boolean, x0 double, x1 double"
        ).toPandas().sort_values(["id", "x0", "x1"])

    known = inputs(rows.filter("_curve"))
    if known["y"].nunique() < 2:
        known = inputs(rows)
    y = known["y"].to_numpy(float)
    if len(set(y)) < 2:
        model.shift = 0.0 if not len(y) else (10.0 if y[0] else -10.0)
        return model
    x = known[["x0", "x1"]].to_numpy(float)
    model.weights, model.center, model.shift = _curve(x, y)
    # The classes were drawn evenly up to their bounds; the shift follows their true shares.
    share = clean.agg(F.avg("_y")).first()[0]
    model.shift += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for batch in batches:
            x = np.array([sizes.inputs(t.as_py()) for t in batch.column("text")]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array(model.probability(x), pa.float64())],
                names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return (rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))
