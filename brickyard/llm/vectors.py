"""Near-duplicate vectors: product quantisation on coarse inverted lists, exact cosine rerank.

1. Rows with equal vectors form a class, so copies cost one entry however many there are.
2. ``fit`` makes the coarse centroids, the subspace codebooks of residuals and the hubs from a
   sample of at most ``FIT_VALUES`` numbers, taken by hash. A hub is a vector with many near
   ones in the sample.
3. Every class is indexed. One within half the linking angle of a hub goes to the hub's own list:
   by the triangle inequality all vectors there link, which is counted, not compared. Others go
   to the list of their best centroid. An entry holds the codes of its residual and the length
   of what the codes leave out.
4. Every class asks its own list and all lists whose centroid scores at most a margin below its
   best one. The margin is ``SIGMAS`` standard deviations of that difference at a partner just at
   the threshold, so sufficient lists are asked at any distance. Hubs are asked by the exact
   bound. Lists are cut into blocks of entries and parts of asking classes.
5. In a block, asymmetric distances come from one table per asking class and subspace. An entry
   passes if its distance, less the length left out, allows a link, so the codes lose no
   link; what passes is reranked by the exact cosine in double precision. Both classes of a pair
   may ask each other; the pair counts in one of the two places.
6. A task returns link counts and a forest of its links, never the pairs.

Defined results: a row whose vector is null, zero or holds null or non-finite numbers, whose
length is not the most frequent one (of several, the greatest), or that has no vec_id, links
with nothing; without vec_id its component is null and it is kept. Every row counts as a vector;
rows that repeat a vec_id are compared like others and share a component. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm import words as W
from brickyard.llm.common import parts, stage
from brickyard.operators.components import connected_components

LEAST = 0.9              # cosine of linked vectors
FIT_VALUES = 1 << 20     # numbers of the vectors to fit on
LISTS = 4096             # coarse centroids at most
SIGMAS = 2.0             # margin of the lists asked
WIDTH = 4                # numbers of a subspace
CODES = 256
HUBS, HUB_LEAST = 1024, 8  # hubs at most; near vectors in the sample that make one
BLOCK = 1 << 13          # entries of a block
ASKING = 1 << 16         # asking classes of a part
CELL_ROWS = 1 << 17      # rows a task is planned for
PAIRS = 1 << 21          # distances held at once

_ENTRY = ("list int, rep bigint, k1 bigint, m bigint, codes binary, lost float, vec binary, "
          "asks binary, asked bigint")
_ROUTED = ("cell bigint, side int, list int, home int, rep bigint, k1 bigint, m bigint, codes binary, "
           "lost float, vec binary, asks binary")
_FOUND = "a bigint, b bigint, k1 bigint, n bigint"


@dataclass
class Index:
    """What ``fit`` learns: unit centres (centroids, then hubs) and codebooks per subspace."""

    centres: np.ndarray
    lists: int
    books: list[np.ndarray]
    cuts: np.ndarray
    least: float

    @property
    def angle(self) -> float:
        return math.acos(self.least)

    @property
    def core(self) -> float:
        """Greatest angle to a hub of the entries of its list."""
        return self.angle / 2 - 1e-6

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home list, codes, length left out and asked lists of unit vectors."""
        score = x @ self.centres.T
        coarse, hub = score[:, :self.lists], score[:, self.lists:]
        home = coarse.argmax(axis=1)
        best = coarse[np.arange(len(x)), home]
        margin = SIGMAS * math.sin(self.angle) * math.sqrt(2.0 / x.shape[1])
        asked = score >= math.cos(min(math.pi, self.angle + self.core))
        asked[:, :self.lists] = coarse >= best[:, None] - margin
        if hub.shape[1]:
            near = hub.argmax(axis=1)
            inside = hub[np.arange(len(x)), near] >= math.cos(self.core)
            home = np.where(inside, near + self.lists, home)
            asked[np.flatnonzero(inside), home[inside]] = False
        rest = x - self.centres[home]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m]:self.cuts[m + 1]]
            codes[:, m] = ((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)
            rest[:, self.cuts[m]:self.cuts[m + 1]] -= book[codes[:, m]]
        lost = np.sqrt((rest**2).sum(axis=1)).astype(np.float32)
        row, column = np.nonzero(asked)
        bounds = np.searchsorted(row, np.arange(1, len(x)))
        return home, codes, lost, np.split(column.astype(np.int32), bounds)


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centred(x: np.ndarray, k: int, rounds: int, rng, unit: bool) -> np.ndarray:
    """Centres of ``k`` clusters of the rows of ``x``."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (0 if unit else (centres**2).sum(axis=1) / 2)).argmax(axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        live = size > 0
        centres[live] = total[live] / size[live, None]
        if unit:
            norm = np.sqrt((centres**2).sum(axis=1))
            centres[norm > 0] /= norm[norm > 0, None]
    return centres


def _hubs(x: np.ndarray, cosine: float) -> np.ndarray:
    """Rows with at least ``HUB_LEAST`` rows within ``cosine``, the fullest first, none near another."""
    count = np.concatenate([(x[a:a + 1024] @ x.T >= cosine).sum(axis=1) for a in range(0, len(x), 1024)])
    free, found = np.ones(len(x), bool), []
    for i in np.argsort(-count, kind="stable"):
        if count[i] < HUB_LEAST or len(found) == HUBS:
            break
        if free[i]:
            found.append(i)
            free &= x @ x[i] < cosine
    return x[found]


def fit(sample: np.ndarray, total: int, least: float = LEAST, seed: int = 7) -> Index:
    """Centroids, hubs and codebooks from sampled vectors of an index of ``total`` entries."""
    rng, x = np.random.default_rng(seed), _units(sample)
    lists = int(max(1, min(LISTS, 2 * math.sqrt(total), len(x) // 4)))
    index = Index(_centred(x, lists, 8, rng, True), lists, [], np.zeros(0, np.int64), least)
    index.centres = np.concatenate((index.centres, _hubs(x, math.cos(index.core))))
    home = index.encoded(x)[0]
    rest = (x - index.centres[home])[:1 << 13]
    count = max(1, x.shape[1] // WIDTH)
    index.cuts = np.linspace(0, x.shape[1], count + 1).astype(np.int64)
    index.books = [_centred(rest[:, a:b], min(CODES, len(rest)), 6, rng, False)
                   for a, b in zip(index.cuts[:-1], index.cuts[1:])]
    return index


def _entries(model, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind)
            vectors = values.reshape(batch.num_rows, -1)
            home, codes, lost, asks = index.encoded(_units(vectors))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int32()), batch.column("rep"), batch.column("k1"), batch.column("m"),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost),
                 pa.array([v.tobytes() for v in vectors], pa.binary()),
                 pa.array([a.tobytes() for a in asks], pa.binary()), none], names=_names(_ENTRY))
            count = np.bincount(np.concatenate(asks), minlength=len(index.centres))
            some = np.flatnonzero(count)
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()),
                 none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.float32()),
                 none.cast(pa.binary()), none.cast(pa.binary()), pa.array(count[some])], names=_names(_ENTRY))
    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _routed(blocks: np.ndarray, rows: np.ndarray, first: np.ndarray):
    """Entries to every part of askers of their block, askers to every block of the lists they ask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column("list").to_numpy().astype(np.int64)
            spread = W.mix(batch.column("k1").to_numpy().view(np.uint64))
            block = (spread % blocks[home].astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(home)), rows[home])
            part = W.ragged(np.zeros(len(home), np.int64), rows[home])
            yield _sent(batch, at, first[home[at]] + block[at] * rows[home[at]] + part, home[at], 0)
            asks = [np.frombuffer(a.as_buffer(), np.int32) for a in batch.column("asks")]
            at = np.repeat(np.arange(len(home)), [len(a) for a in asks])
            to = np.concatenate(asks).astype(np.int64)
            part = (spread[at] % rows[to].astype(np.uint64)).astype(np.int64)
            many = blocks[to]
            block = W.ragged(np.zeros(len(to), np.int64), many)
            at, to, part = np.repeat(at, many), np.repeat(to, many), np.repeat(part, many)
            for a in range(0, len(at), 1 << 14):
                s = slice(a, a + (1 << 14))
                yield _sent(batch, at[s], first[to[s]] + block[s] * rows[to[s]] + part[s], to[s], 1)
    return run


def _sent(batch: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, to: np.ndarray, side: int) -> pa.RecordBatch:
    rows = batch.take(pa.array(at))
    codes = pa.nulls(len(at), pa.binary()) if side else rows.column("codes")  # askers need none
    return pa.RecordBatch.from_arrays(
        [pa.array(cell), pa.array(np.full(len(at), side, np.int32)), pa.array(to.astype(np.int32)),
         rows.column("list"), rows.column("rep"), rows.column("k1"), rows.column("m"), codes,
         rows.column("lost"), rows.column("vec"), rows.column("asks")], names=_names(_ROUTED))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Cell:
    """The entries of one block, and the links that its askers find."""

    def __init__(self, model: Index, kind: str):
        self.model, self.kind, self.read = model, kind, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.read.append(rows)

    def ready(self) -> None:
        rows = pa.Table.from_batches(self.read)
        self.read = []
        self.list = rows.column("list")[0].as_py()
        self.rep, self.k1, self.m = (rows.column(c).to_numpy() for c in ("rep", "k1", "m"))
        self.codes = _matrix(rows.column("codes"), "u1").astype(np.int64)
        self.lost = rows.column("lost").to_numpy()
        self.x = _units(_matrix(rows.column("vec"), self.kind))
        asks = [np.frombuffer(a, np.int32) for a in rows.column("asks").to_pylist()]
        lists = len(self.model.centres)
        self.asks = np.sort(np.concatenate([a.astype(np.int64) + i * lists for i, a in enumerate(asks)]))
        self.count = np.zeros(len(self.m), np.int64)

    def ask(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = max(1, PAIRS // len(self.m))
        for a in range(0, rows.num_rows, size):
            yield from self._ask(rows.slice(a, size))

    def _ask(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, rep, k1, m = self.model, *(rows.column(c).to_numpy() for c in ("rep", "k1", "m"))
        home = rows.column("home").to_numpy().astype(np.int64)
        q = _units(_matrix(rows.column("vec"), self.kind))
        near = np.repeat((q @ model.centres[self.list]).astype(np.float32)[:, None], len(self.m), axis=1)
        for j, book in enumerate(model.books):
            table = (q[:, model.cuts[j]:model.cuts[j + 1]] @ book.T).astype(np.float32)
            near += table[:, self.codes[:, j]]
        i, e = np.nonzero(near + self.lost >= model.least - 1e-4)
        del near
        exact = np.concatenate([np.zeros(0), *((q[i[a:a + (1 << 16)]] * self.x[e[a:a + (1 << 16)]]).sum(axis=1)
                                               for a in range(0, len(i), 1 << 16))])
        hit = exact >= model.least
        i, e = i[hit], e[hit]
        back = home[i] + e * len(model.centres)  # the entry asks the asker's list as well
        at = np.minimum(np.searchsorted(self.asks, back), len(self.asks) - 1) if len(self.asks) else back * 0
        mutual = self.asks[at] == back if len(self.asks) else np.zeros(len(i), bool)
        less = (rep[i] < self.rep[e]) | ((rep[i] == self.rep[e]) & (k1[i] < self.k1[e]))
        own = np.where(home[i] == self.list, less, (self.list < home[i]) | ~mutual)
        i, e = i[own], e[own]
        if not len(i):
            return
        np.add.at(self.count, e, m[i])
        count = np.zeros(len(m), np.int64)
        np.add.at(count, i, self.m[e])
        some = np.flatnonzero(count)
        yield _found(rep[some], rep[some], k1[some], count[some])
        label = np.concatenate((rep, self.rep))
        i, e = i, e + len(rep)
        while True:  # smallest id along the links, for a forest of them
            low = np.minimum(label[i], label[e])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, e, low)
            if (new == label).all():
                break
            label = new
        node = np.concatenate((rep, self.rep))
        some = np.flatnonzero(label != node)
        both = np.unique(np.stack([node[some], label[some]], axis=1), axis=0)
        none = np.zeros(len(both), np.int64)
        yield _found(both[:, 0], both[:, 1], none, none)

    def counted(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.count)
        yield _found(self.rep[some], self.rep[some], self.k1[some], self.count[some])


def _found(a, b, k1, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in (a, b, k1, n)],
                                      names=["a", "b", "k1", "n"])


def _scanned(model, kind: str):
    """The cells of a partition, whose rows come by cell, entries before askers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now, open_ = None, None, False
        for batch in batches:
            ids, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            change = (ids[1:] != ids[:-1]) | (side[1:] != side[:-1])
            edges = [0, *(np.flatnonzero(change) + 1), len(ids)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if ids[a] != now:
                    if cell is not None and not open_:
                        yield from cell.counted()
                    cell, now, open_ = None, ids[a], True
                rows = batch.slice(a, b - a)
                if side[a] == 0:
                    cell = cell or _Cell(model.value, kind)
                    cell.add(rows)
                elif cell is not None:  # a block without entries has nothing to ask
                    if open_:
                        cell.ready()
                        open_ = False
                    yield from cell.ask(rows)
        if cell is not None and not open_:
            yield from cell.counted()
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 least: float = LEAST) -> DataFrame:
    """One row per row: vec_id, n_links, component_id (smallest linked vec_id), kept."""
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    v = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(
        finite & F.exists("v", lambda x: x != 0))
    size = sound.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    if size is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    use = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") == size.s) & finite
                     & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"k1": F.when(use, F.xxhash64(F.lit(1), "v")),
                             "k2": F.when(use, F.xxhash64(F.lit(2), "v"))})
    classes = stage(rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v")), "vector-classes")
    named = stage(rows.select("vec_id", "k1", "k2").join(
        classes.select("k1", "k2", "rep", "m"), ["k1", "k2"], "left"), "vector-rows")
    links = _links(spark, classes, size.s, kind, least)
    counts = links.filter("n > 0").groupBy(F.col("a").alias("rep"), "k1").agg(F.sum("n").alias("linked"))
    repeats = (named.filter("rep IS NOT NULL").groupBy("vec_id")
               .agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high"))
    repeats = named.join(repeats.select("vec_id"), "vec_id", "left_semi").filter("rep IS NOT NULL")
    edges = (links.filter("n = 0").select("a", "b")
             .unionByName(repeats.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    labels = stage(connected_components(edges.filter("a <> b"), "a", "b"), "vector-labels")
    component = F.coalesce("label", "rep", "vec_id")
    return (named.join(counts, ["rep", "k1"], "left").join(labels, F.col("rep") == F.col("node"), "left")
            .select("vec_id", (F.coalesce("m", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                    component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))


def _links(spark, classes: DataFrame, size: int, kind: str, least: float) -> DataFrame:
    """Rows (a, b, k1, n): n > 0 linked vectors of class (a, k1); n = 0 a link between a and b."""
    total, taken = classes.count(), max(64, FIT_VALUES // size)
    sample = classes.select("v", "k1", "rep").orderBy(F.xxhash64("k1"), "rep").limit(taken).select("v").toArrow()
    values = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    model = fit(values.reshape(-1, size), total, least)
    lists = model.lists
    shared = spark.sparkContext.broadcast(model)
    index = stage(classes.select("rep", "k1", "m", "v").mapInArrow(_entries(shared, kind), _ENTRY), "vector-index")
    entries = index.filter("asked IS NULL").drop("asked")
    centres = len(model.centres)
    held, asked = np.zeros(centres, np.int64), np.zeros(centres, np.int64)
    hubs = {}
    for r in index.groupBy("list").agg(F.count("rep").alias("n"), F.sum("asked").alias("asked"),
                                       F.sum("m").alias("m"), F.min("rep").alias("least")).collect():
        held[r.list], asked[r.list] = r.n, r.asked or 0
        if r.list >= lists:
            hubs[r.list] = (r.m, r.least)
    blocks, rows = np.maximum(1, -(-held // BLOCK)), np.maximum(1, -(-asked // ASKING))
    first = np.concatenate(([0], np.cumsum(blocks * rows)[:-1]))
    work = parts(float((held * rows + asked * blocks).sum()), CELL_ROWS, 12)
    found = (entries.mapInArrow(_routed(blocks, rows, first), _ROUTED).repartition(work, "cell")
             .sortWithinPartitions("cell", "side").mapInArrow(_scanned(shared, kind), _FOUND))
    if hubs:
        core = spark.createDataFrame([(k, *x) for k, x in hubs.items()], "list int, total bigint, low bigint")
        inside = entries.select("list", "rep", "k1", "m").join(F.broadcast(core), "list")
        zero = F.lit(0).cast("bigint")
        found = found.unionByName(inside.select(
            F.col("rep").alias("a"), F.col("rep").alias("b"), "k1", (F.col("total") - F.col("m")).alias("n"))
            .filter("n > 0")).unionByName(inside.select(
                F.col("rep").alias("a"), F.col("low").alias("b"), zero.alias("k1"), zero.alias("n")))
    return stage(found, "vector-links")
