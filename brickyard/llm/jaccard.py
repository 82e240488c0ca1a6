"""Similarity self-join on word shingles: prefix, length, positional and suffix filters.

Words are runs of non-white characters, A-Z lower-cased; a document's set holds its distinct
five-word shingles as 64-bit hashes. Two documents link at 100 * shared >= 75 * union.

1. One pass over the texts gives each row's set size, a 128-bit set key and a 256-cell
   histogram, and counts shingles that repeat within a batch of documents. The
   most frequent ones, at most ``ORDER_ROWS``, make the rare-first order; others count as rare and
   are ordered by hash. The order only steers how many candidates there are.
2. Equal sets form classes, named by the first half of their key. A second pass sends each
   set's prefix (one set per batch and key) to buckets of shingles; frequent shingles are
   spread by class. Shingles that one class alone has leave here.
3. Round one pairs each posting with one class of its shingle: as many pairs as postings,
   however large a group of copies is. A bucket does so for its own shingles; those with two
   classes are settled by that pair, all others are written as postings (shingle, class,
   size, position). Pairs pass the length, positional and suffix filters, the last once more
   with a cell per shingle, and are verified once, on whole sets.
4. Shingles whose classes are not all connected by then stay open. While the number of open
   components falls by a tenth, classes outside the commonest component of an open shingle
   try the few members of it that leave the most room, and what links is merged and dropped.
5. The last round meets all classes of different components that share a shingle still open,
   block by block, so every link that could join components is verified. All filters run
   where the blocks meet; only pairs that pass them become rows. Its smaller sides come from
   the shorter index prefix.

Defined results: null, empty or wordless text has an empty set and links with nothing; fewer
than five words are one shingle. A row without doc_id links with nothing and has a null
component. Rows that repeat a doc_id are one node, linked through each of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm import words as W
from brickyard.llm.common import fresh, parts, stage
from brickyard.operators.components import connected_components

WIDTH = 5
SHARE = 75            # per cent of the union that linked sets have in common
CELLS = 256           # cells of the suffix filter's histogram
ORDER_ROWS = 1 << 17  # shingles with a known frequency, the most frequent ones
TRIES = 4             # members of a shingle's commonest component that another class tries at once
BLOCK_ROWS = 1 << 11  # classes of a shingle that one task holds against as many
PAIRS = 1 << 20       # pairs looked at in one step
BUCKET_ROWS = 1 << 20  # prefix postings a bucket is planned for

BROADCAST_ROWS = 1 << 20  # counted ids up to which texts are picked without a shuffle

_INFO = ("doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, cells binary, "
         "shingle bigint, times bigint")
_POSTING = np.dtype([("shingle", "<i8"), ("class", "<i8"), ("n", "<i4"), ("pos", "<i4")])
_SHARED = pa.schema([("shingle", pa.int64()), ("class", pa.int64()), ("n", pa.int32()),
                     ("pos", pa.int32()), ("frequent", pa.bool_()), ("other", pa.int64())])


def text_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in W.texts(column):
        low = W.LOWER[data]
        start, end, row = W.spans(low, offsets)
        runs, bounds = W.shingles(W.hashes(low, start, end), row, len(offsets) - 1, width)
        for r in range(len(offsets) - 1):
            yield np.unique(runs[bounds[r]:bounds[r + 1]])


def _key(s: np.ndarray) -> tuple[int, int]:
    one = W.mix(s).sum(dtype=np.uint64)
    two = W.mix(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _cells(s: np.ndarray, cells: int = CELLS) -> bytes | None:
    """Set size in each cell of the hash space, or None for sets too large for one byte.

    ``cells`` is a power of two.
    """
    count = np.bincount((s >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else None


def _room(x: bytes | None, y: bytes | None, n: int, m: int) -> int:
    """Upper bound of the overlap of two sets of ``n`` and ``m`` with cells ``x`` and ``y``."""
    if x is None or y is None:
        return min(n, m)
    one, two = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(one) > len(two):
        one = one.reshape(len(two), -1).sum(axis=1)
    elif len(two) > len(one):
        two = two.reshape(len(one), -1).sum(axis=1)
    return int(np.minimum(one, two).sum())


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()),
                            ("k2", pa.int64()), ("cells", pa.binary()), ("shingle", pa.int64()),
                            ("times", pa.int64())])
        for batch in batches:
            size, one, two, cells, first = [], [], [], [], {}
            for s in text_sets(batch.column("text"), width):
                key = _key(s)
                size.append(len(s))
                one.append(key[0])
                two.append(key[1])
                cells.append(_cells(s))
                first.setdefault(key, s)
            none = [None] * len(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.array(cells, pa.binary()),
                 pa.array(none, pa.int64()), pa.array(none, pa.int64())], schema=schema)
            every = np.concatenate(list(first.values())) if first else np.zeros(0, np.uint64)
            every.sort()
            edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))[:len(every)]
            times = np.diff(np.append(edge, len(every)))
            often = times > 1
            if often.any():
                none = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.nulls(len(none), pa.binary()),
                     pa.array(every[edge[often]].view(np.int64)), pa.array(times[often])],
                    schema=schema)
    return run


def _prefixes(width: int, share: int, order, buckets: int):
    """Buckets of prefix postings as binary columns, a row per batch and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = order.value
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            seen, found = set(), []
            for doc, s in zip(batch.column("doc_id").to_pylist(),
                              text_sets(batch.column("text"), width)):
                n = len(s)
                if not n or doc is None or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                keep = n + (-share * n // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, times[at], 0)
                    s = s[np.lexsort((s, weight))] if weight.any() else s
                post = np.empty(keep, _POSTING)
                post["shingle"], post["class"] = s[:keep].view(np.int64), key[0]
                post["n"], post["pos"] = n, np.arange(keep)
                found.append(post)
            if not found:
                continue
            post = np.concatenate(found)
            spread = post["shingle"].view(np.uint64).copy()
            frequent = np.isin(spread, known)
            spread[frequent] = W.mix(spread[frequent] ^ post["class"][frequent].view(np.uint64))
            bucket = (W.mix(spread) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            post, bucket = post[by], bucket[by]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            stop = np.append(edge[1:], len(bucket))
            blobs = [pack.compress(b"".join(post[name][a:b].tobytes() for name in _POSTING.names))
                     for a, b in zip(edge, stop)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(blobs, pa.binary())],
                                             names=["bucket", "postings"])
    return run


def _columns(blob: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(blob) // _POSTING.itemsize, 0, {}
    for name in _POSTING.names:
        out[name] = np.frombuffer(blob, _POSTING[name], n, at)
        at += n * _POSTING[name].itemsize
    return out


def _bucket(blobs: list[bytes], known: np.ndarray, share: int) -> Iterator[pa.RecordBatch]:
    """Postings of a bucket that later rounds need, and its pairs of round one.

    The pivot of a shingle is its smallest class. Frequent shingles are spread over buckets,
    so their postings all stay and meet their pivots later.
    """
    unpack = zstandard.ZstdDecompressor()
    read = [_columns(unpack.decompress(b)) for b in blobs]
    post = {name: np.concatenate([b[name] for b in read]) for name in _POSTING.names}
    del read
    by = np.argsort(post["shingle"], kind="stable")
    shingle = post["shingle"][by]
    same = shingle[1:] == shingle[:-1]
    often = np.isin(shingle.view(np.uint64), known)
    by = by[np.concatenate((same, [False])) | np.concatenate(([False], same)) | often]
    by = by[np.lexsort([post[name][by] for name in ("pos", "n", "class", "shingle")])]
    post = {name: x[by] for name, x in post.items()}
    new = np.ones(len(by), bool)
    new[1:] = np.any([post[name][1:] != post[name][:-1] for name in ("shingle", "class", "n")], axis=0)
    post = {name: x[new] for name, x in post.items()}
    shingle = post["shingle"]
    first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))[:len(shingle)])
    count = np.diff(np.append(first, len(shingle)))
    often = np.isin(shingle.view(np.uint64), known)
    size, pivot = np.repeat(count, count), np.repeat(first, count)

    at = np.flatnonzero(often | (size > 2))
    for a in range(0, len(at), 1 << 16):
        part = at[a:a + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(post[name][part]) for name in _POSTING.names], pa.array(often[part]),
             pa.nulls(len(part), pa.int64())], schema=_SHARED)

    row = np.flatnonzero(~often & (post["class"] != post["class"][pivot]))
    pivot = pivot[row]
    na, nb = post["n"][row].astype(np.int64), post["n"][pivot].astype(np.int64)
    pa_, pb = post["pos"][row].astype(np.int64), post["pos"][pivot].astype(np.int64)
    room = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
    fits = ((100 * np.minimum(na, nb) >= share * np.maximum(na, nb))
            & ((100 + share) * room >= share * (na + nb)))
    pairs = np.unique(np.stack([post["class"][row[fits]], post["class"][pivot[fits]]], axis=1), axis=0)
    for a in range(0, len(pairs), 1 << 16):
        part = np.ascontiguousarray(pairs[a:a + (1 << 16)].T)
        none = len(part[0])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(none, pa.int64()), pa.array(part[0]), pa.nulls(none, pa.int32()),
             pa.nulls(none, pa.int32()), pa.nulls(none, pa.bool_()), pa.array(part[1])],
            schema=_SHARED)


def _shared(order, share: int):
    """``_bucket`` of each bucket of a partition, whose rows come in order of the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, blobs = order.value[0], None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("postings")):
                if blobs and bucket != now:
                    yield from _bucket(blobs, known, share)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from _bucket(blobs, known, share)
    return run


def _suffix(share: int):
    """Drop pairs whose histograms leave too little room for the overlap they need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_pylist() for c in ("na", "nb")]
            keep = [(100 + share) * _room(x.as_py(), y.as_py(), n, m) >= share * (n + m)
                    for x, y, n, m in zip(batch.column("ca"), batch.column("cb"), *sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verified(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                one = np.frombuffer(x.as_buffer(), np.uint64)
                two = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= share * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _met(share: int, tries: int):
    """Pairs of the classes of each (shingle, x, y), whose rows come together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shingle", "x", "y")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and tuple(keys[a]) != now:
                    yield from _pairs_of(pa.Table.from_batches(held), share, tries)
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from _pairs_of(pa.Table.from_batches(held), share, tries)
    return run


def _pairs_of(rows: pa.Table, share: int, tries: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that pass the length, positional and suffix filters; see ``_open_pairs``.

    At the first shingle two sets share, the overlap is at most what either has from there on,
    and later shared shingles only leave less; so each row is held to that bound. The smaller
    set can meet it in its index prefix alone, which is shorter.
    """
    size, pos, label, name, rep, own = (
        rows.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "label", "class", "rep", "own"))
    if len(size) < 2 or (label == label[0]).all():
        return
    s, two = share, bool(own.min() != own.max())
    flat = [c if c is not None else b"" for c in rows.column("cells").to_pylist()]
    known = np.array([len(c) > 0 for c in flat])
    cells = np.frombuffer(b"".join(c or bytes(CELLS) for c in flat), np.uint8).reshape(len(flat), CELLS)
    names, kind, times = np.unique(label, return_inverse=True, return_counts=True)
    host = kind == times.argmax()
    small = np.flatnonzero((100 + s) * (size - pos) >= 2 * s * size)
    step = max(1, PAIRS // len(size))
    found = []
    for a in range(0, len(small), step):
        i = small[a:a + step, None]
        need = s * (size[i] + size)
        fits = (kind[i] != kind) & (100 * size[i] >= s * size) & (
            (size[i] < size) | ((size[i] == size) & (name[i] < name))) & (
            (100 + s) * (size[i] - pos[i]) >= need) & ((100 + s) * (size - pos) >= need)
        if two:
            fits &= own[i] != own
        if tries:
            fits &= host[i] != host
        at, j = np.nonzero(fits)
        i = small[a + at]
        for k in range(0, len(i), 1 << 13):
            x, y = i[k:k + (1 << 13)], j[k:k + (1 << 13)]
            room = np.minimum(cells[x], cells[y]).sum(axis=1, dtype=np.int64)
            room = np.where(known[x] & known[y], room, size[x])
            gap = (100 + s) * room - s * (size[x] + size[y])
            found.append(np.stack([x, y, gap])[:, gap >= 0])
    x, y, gap = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    if tries and len(x):  # per class outside the host the pairs with the widest gap
        out = np.where(host[x], y, x)
        by = np.lexsort((-gap, out))
        first = np.flatnonzero(np.concatenate(([True], out[by][1:] != out[by][:-1])))
        order = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        x, y = x[by[order < tries]], y[by[order < tries]]
    pairs = np.unique(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])], axis=1), axis=0)
    for a in range(0, len(pairs), 1 << 16):
        part = np.ascontiguousarray(pairs[a:a + (1 << 16)].T)
        yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], names=["a", "b"])


class Join:
    """The stages of one similarity self-join; ``components`` is its result."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = WIDTH, share: int = SHARE):
        self.spark, self.width, self.share = docs.sparkSession, width, share
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                                F.col(text_col).alias("text"))
        self.info = stage(self.docs.mapInArrow(_scan(width), _INFO), "jaccard-info")
        self.rows = self.info.filter("n_shingles IS NOT NULL").drop("shingle", "times")
        named = self.rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
        self.classes = stage(named.groupBy("k1", "k2", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.first("cells").alias("cells")), "jaccard-classes")
        self.named_classes = self.classes.select(F.col("k1").alias("class"), "rep")
        self.nodes = stage(named.join(self.classes, ["k1", "k2", "n_shingles"])
                           .select("doc_id", "rep").distinct(), "jaccard-nodes")
        shared = self._shared()
        self.pairs = shared.filter("other IS NOT NULL").select(
            F.col("class").alias("a"), F.col("other").alias("b"))
        self.postings = shared.filter("other IS NULL").drop("other")

    def _order(self):
        """Frequent shingles and their counts: all above the count that ORDER_ROWS allows."""
        times = stage(self.info.filter("shingle IS NOT NULL").groupBy("shingle")
                      .agg(F.sum("times").alias("times")), "jaccard-times")
        size = F.floor(F.log2("times")).cast("int")
        least, rows = 1 << 62, 0
        for power, n in times.groupBy(size.alias("p")).count().orderBy(F.desc("p")).collect():
            rows += n
            if rows > ORDER_ROWS:
                break
            least = 1 << power
        top = times.filter(F.col("times") >= least).toPandas()
        known = top["shingle"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(known)
        return self.spark.sparkContext.broadcast((known[by], top["times"].to_numpy(np.int64)[by]))

    def _shared(self) -> DataFrame:
        """Written postings and, with ``other``, the pairs that the buckets found."""
        order = self._order()
        total = self.rows.agg(F.sum(F.col("n_shingles") * (100 - self.share) / 100 + 1)).first()[0]
        buckets = parts(total, BUCKET_ROWS, 4)
        packed = self.docs.mapInArrow(_prefixes(self.width, self.share, order, buckets),
                                      "bucket int, postings binary")
        return stage(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
            _shared(order, self.share), "shingle bigint, class bigint, n int, pos int, "
            "frequent boolean, other bigint"), "jaccard-postings")

    def _passing(self, pairs: DataFrame) -> DataFrame:
        """Distinct written pairs of rows (a, b) of the suffix-filtered pairs of classes."""
        pairs = (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                 .filter("a <> b").distinct())
        for side in "ab":
            cells = self.classes.select(
                F.col("k1").alias(side), F.col("rep").alias(f"r{side}"),
                F.col("n_shingles").alias(f"n{side}"), F.col("cells").alias(f"c{side}"))
            pairs = pairs.join(cells, side)
        kept = (pairs.filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "na", "nb", "ca", "cb")
            .mapInArrow(_suffix(self.share), "a bigint, b bigint"))
        return stage(kept.distinct(), "jaccard-pairs")

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough."""
        width = self.width

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, cells, out = [], [], []
                for s in text_sets(batch.column("text"), width):
                    size.append(len(s))
                    cells.append(_cells(s, max(CELLS, 1 << len(s).bit_length())))
                    out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(cells, pa.binary()),
                     pa.array(out, pa.binary())], names=["rep", "n", "cells", "items"])

        def due(pairs: DataFrame, name: str) -> DataFrame:
            ids = stage(pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct(), "jaccard-due")
            return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

        items = stage(self.docs.join(due(pairs, "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
                      .mapInArrow(sets, "rep bigint, n bigint, cells binary, items binary"),
                      "jaccard-sets")
        fine = pairs
        for side in "ba":
            fine = fine.join(items.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"),
                                          F.col("cells").alias(f"c{side}")), side)
        pairs = stage(fine.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(
            _suffix(self.share), "a bigint, b bigint").distinct(), "jaccard-fine")
        items = items.join(due(pairs, "rep"), "rep", "left_semi")
        both = (pairs.join(items.select(F.col("rep").alias("b"), F.col("items").alias("sb")), "b")
                .join(items.select(F.col("rep").alias("a"), F.col("items").alias("sa")), "a"))
        return stage(both.select("a", "b", "sa", "sb").mapInArrow(
            _verified(self.share), "a bigint, b bigint").distinct(), "jaccard-links")

    def _pivot_pairs(self, post: DataFrame) -> DataFrame:
        """A pair of classes for each posting, with the smallest class of its shingle.

        The length filter and the positional filter for any shared shingle hold for every pair;
        what is left out here is met in ``_open_pairs``.
        """
        s = self.share
        own = F.struct(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
        pivots = stage(post.groupBy("shingle").agg(
            F.min(own).alias("pivot"), F.min("class").alias("low"), F.max("class").alias("high"))
            .filter("low < high").select("shingle", "pivot.*"), "jaccard-pivots")
        rows = post.join(pivots, "shingle").withColumnsRenamed({"class": "a", "n": "na", "pos": "pa"})
        room = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        return (rows.filter(
            (F.col("a") != F.col("b")) & (100 * F.least("na", "nb") >= s * F.greatest("na", "nb"))
            & ((100 + s) * room >= s * (F.col("na") + F.col("nb")))).select("a", "b"))

    def _open(self, post: DataFrame, labels: DataFrame) -> DataFrame:
        """Labelled rows of ``post`` whose shingle's classes are not all in one component."""
        roots = labels.select(F.col("label").alias("node"), "label").distinct()
        known = stage(self.named_classes.join(labels.unionByName(roots), F.col("rep") == F.col("node"))
                      .select("class", "label"), "jaccard-known")
        known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
        post = (post.drop("label").join(known, "class", "left")
                .select("shingle", "class", "n", "pos", F.coalesce("label", "class").alias("label")))
        post = stage(post, "jaccard-labelled")
        mixed = (post.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                 .filter("low < high").select("shingle"))
        return stage(post.join(mixed, "shingle", "left_semi"), "jaccard-open")

    def _open_pairs(self, post: DataFrame, tries: int = 0) -> DataFrame:
        """Distinct rows (a, b) of different components that pass all filters at a shingle of ``post``.

        With ``tries``, a class outside the commonest component of its shingle and block meets
        the ``tries`` members of it that leave the most room. Without, all pairs are met: each
        block of a shingle meets each other block.
        """
        rows = post.join(self.classes.select(F.col("k1").alias("class"), "rep", "cells"), "class")
        cuts = (post.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
                .filter("blocks > 1"))
        rows = rows.join(cuts, "shingle", "left").withColumn(
            "blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
        own = F.pmod(F.xxhash64("class"), F.col("blocks"))
        meets = F.array(own) if tries else F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
        rows = rows.select("shingle", "class", "n", "pos", "label", "rep", "cells", own.alias("own"),
                           F.explode(meets).alias("met"))
        rows = rows.withColumns({"x": F.least("own", "met"), "y": F.greatest("own", "met")})
        found = (rows.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
                 .mapInArrow(_met(self.share, tries), "a bigint, b bigint"))
        return stage(found.distinct(), "jaccard-met")

    def labels(self) -> DataFrame:
        """(node, label) of every class representative that is linked with another."""
        repeats = (self.nodes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
                   .filter("a < b").select("a", "b"))
        own = (self.nodes.join(repeats.select("b"), F.col("rep") == F.col("b"), "left_semi")
               .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
        often = self.postings.filter("frequent")
        seen = self._passing(self.pairs.unionByName(self._pivot_pairs(often)))
        links = stage(self._links(seen).unionByName(repeats).unionByName(own).filter("a <> b")
                      .distinct(), "jaccard-edges")
        labels = stage(connected_components(links, "a", "b"), "jaccard-labels")
        post, last = self._open(self.postings, labels), None
        while True:
            count = post.select("label").distinct().count()
            tries = TRIES if last is None or 10 * count < 9 * last else 0
            more = self._open_pairs(post, tries) if count else None
            if more is not None:
                more = stage(more.join(seen, ["a", "b"], "left_anti"), "jaccard-more")
            new = None if more is None or more.isEmpty() else self._links(more)
            if new is not None:
                seen = seen.unionByName(more)
                if not new.isEmpty():
                    links = links.unionByName(new)
                    labels = stage(connected_components(links, "a", "b"), "jaccard-labels")
            if not count or not tries:
                return labels
            last = count
            if new is not None:
                post = self._open(post, labels)

    def components(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id."""
        named = (self.rows.join(self.classes.drop("cells"), ["k1", "k2", "n_shingles"], "left")
                 .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(),
                                                        F.coalesce("rep", "doc_id")).alias("rep")))
        return (named.join(self.labels(), F.col("rep") == F.col("node"), "left")
                .select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id linked to it)."""
    return Join(docs, id_col, text_col).components()


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                            ) -> DataFrame:
    """``docs`` with the smallest doc_id of each component and every row without id."""
    gone = fresh(docs, "_gone")
    drop = stage(near_duplicates(docs, id_col, text_col).filter("doc_id <> component_id")
                 .select(F.col("doc_id").alias(gone)).distinct(), "jaccard-drop")
    return docs.join(drop, F.col(id_col) == F.col(gone), "left_anti").select(docs.columns)
