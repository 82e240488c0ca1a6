"""Cross-source duplicate resolution: block, link, cluster, survive, coalesce, report.

Two listings match when they share a block, their prices are within five percent of the
larger (a missing price matches any) and, if both have coordinates, they are at most 40 m
apart (missing coordinates match any). Clusters are the connected components of that
relation (true single link).

Enumerating all matching pairs of a block is quadratic, and a block of address-less
listings may hold a large share of the table. :func:`duplicate_links` therefore emits a
linear number of links with the same components: rows equal in everything the match looks
at become one node first, and nodes link only to their neighbours in price order - among
the unlocated nodes of the block, and among the nodes of a cell less than 40 m across, in four
shifted grids. Between neighbouring cells, nodes that are not joined by then try the next one
in price of the other cell; all pairs are tried only of what is still apart after that. Prices
are split into bands slightly wider than the tolerance, each band seeing the next one, so that
a sort covers one band of one block.

Nearly all blocks are small. :func:`dedup_clusters` sends the rows of blocks of at most
``SMALL_BLOCK`` rows to one task per block, by a hash of the block, and clusters them there: one
shuffle of the rows and nothing written. Only larger blocks take the links above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from brickyard.functions import geo, text
from brickyard.operators.clean import count_filled
from brickyard.operators.components import connected_components
from brickyard.schema import EARTH_RADIUS_M
from brickyard.session import cut, written

# Fixed values of the match.
PRICE_TOLERANCE = 0.05
GEO_TOLERANCE_M = 40.0
SURFACE_BUCKET = 5.0

SEVERAL = "_several"  # mark of listings whose cluster has more than one
LARGE = "_large"      # and of those in a block of more than SMALL_BLOCK rows

SMALL_BLOCK = 1_024   # rows of a block that one task clusters
TASK_ROWS = 250_000
_BUCKETS = 1 << 17    # of block hashes, counted to find large blocks
_PAIRS = 1 << 20      # pairs compared at once

_BAND = 1.0002 * -math.log(1.0 - PRICE_TOLERANCE)
_PLACE_DEG = 1.001 * GEO_TOLERANCE_M / 111_194.0
_CELL_DEG = 0.998 * GEO_TOLERANCE_M / 111_195.0 / math.sqrt(2.0)


# -- distinct ----------------------------------------------------------------
def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter lets Spark keep one row per key before the shuffle, so a hot key
    shuffles one row per input task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 1").drop("_rn")


def dedup_by_url(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row per URL; rows without a URL are all kept (keyed by their id)."""
    keyed = df.withColumn("_k", F.coalesce(F.concat(F.lit("u:"), F.col("url")),
                                           F.concat(F.lit("i:"), F.col("listing_id"))))
    return first_per_key(keyed, ["_k"], order).drop("_k")


# -- block -------------------------------------------------------------------
def blocking_key(df: DataFrame) -> dict[str, Column]:
    """Columns of the block key; missing parts compare equal."""
    surface = F.col("livable_surface")
    return {
        "block_postal": F.coalesce(F.col("postal_code").cast("string"), F.lit("")),
        "block_street": F.concat(text.norm_key(F.coalesce("street", F.lit(""))),
                                 F.coalesce(F.col("house_number").cast("string"), F.lit(""))),
        "block_surface": F.when(surface != 0, F.rint(surface / SURFACE_BUCKET)),
        "block_bedrooms": F.col("bedrooms").cast("double"),
    }


def block_of(df: DataFrame, within: Sequence[str] = ("market",), isolate_null_keys: bool = False) -> Column:
    """The block of a listing as one text; duplicates are only looked for inside a block."""
    parts = blocking_key(df)
    pieces = [F.coalesce(c.cast("string"), F.lit("")) for c in
              [*(F.col(w) for w in within), *parts.values()]]
    block = F.concat_ws("\x1f", *pieces)
    if isolate_null_keys:
        blank = (parts["block_postal"] == "") | (parts["block_street"] == "")
        block = F.when(blank, F.concat(F.lit("\x1e"), F.col("listing_id"))).otherwise(block)
    return block


def _with_block(df: DataFrame, within: Sequence[str], isolate_null_keys: bool) -> DataFrame:
    block = block_of(df, within, isolate_null_keys)
    price = F.col("price").cast("double")
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.withColumns({"_block": block, "_p": F.when(price > 0, price),
                           "_lat": F.when(located, F.col("latitude")),
                           "_lon": F.when(located, F.col("longitude"))})


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(PRICE_TOLERANCE) * F.greatest(a, b)


def _banded(nodes: DataFrame) -> DataFrame:
    """Priced nodes once in their own price band and once in the band below it."""
    band = F.floor(F.log(F.col("_p")) / F.lit(_BAND)).cast("bigint")
    return (nodes.filter(F.col("_p").isNotNull())
            .withColumn("_band", F.explode(F.array(band, band - 1))))


def _edge(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a_id"), F.greatest(a, b).alias("b_id")]


def _unlocated_links(nodes: DataFrame) -> DataFrame:
    """Every priced node with the nearest unlocated ones below and above in price."""
    # blocks without an unlocated node have no such link
    blocks = nodes.filter(F.col("_lat").isNull()).select("_block").distinct()
    rows = _banded(nodes.join(blocks, "_block", "left_semi"))
    mark = F.when(F.col("_lat").isNull(), F.struct("_p", "node"))
    part = Window.partitionBy("_block", "_band")
    past = (Window.unboundedPreceding, -1)
    below = F.last(mark, True).over(part.orderBy("_p", "node").rowsBetween(*past))
    above = F.last(mark, True).over(
        part.orderBy(F.desc("_p"), F.desc("node")).rowsBetween(*past))
    near = (rows.withColumn("_below", below).withColumn("_above", above)
            .select("node", "_p", F.explode(F.array("_below", "_above")).alias("_o"))
            .filter(F.col("_o").isNotNull()))
    return (near.select("node", "_p", F.col("_o._p").alias("_op"),
                        F.col("_o.node").alias("_on"))
            .filter(_close(F.col("_p"), F.col("_op"))).select(*_edge("node", "_on")))


def _grid(lat: Column, lon: Column, up: float = 0.0, right: float = 0.0) -> tuple[Column, Column]:
    """Row and column in a grid whose cells are less than the tolerance across, shifted by parts of a cell."""
    row = F.floor(lat / F.lit(_CELL_DEG) + up).cast("bigint")
    south = (row - up) * F.lit(_CELL_DEG)
    flat = F.when(south * (south + F.lit(_CELL_DEG)) <= 0, 0.0).otherwise(
        F.least(F.abs(south), F.abs(south + F.lit(_CELL_DEG)), F.lit(89.9999)))
    width = F.lit(_CELL_DEG) / F.cos(F.radians(flat))
    return row, F.floor(lon / width + right).cast("bigint")


def _cell_links(nodes: DataFrame) -> DataFrame:
    """Neighbours in price order within each cell of four grids; unpriced ones join their cell.

    All members of a cell are within the tolerance of each other, and places at most half a
    cell apart share one in some grid.
    """
    grids = [(up, right) for up in (0.0, 0.5) for right in (0.0, 0.5)]
    cells = []
    for i, (up, right) in enumerate(grids):
        row, column = _grid(F.col("_lat"), F.col("_lon"), up, right)
        cells.append(F.struct(F.lit(i).alias("grid"), row.alias("row"), column.alias("column")))
    members = (nodes.filter(F.col("_lat").isNotNull()).withColumn("_g", F.explode(F.array(*cells)))
               .select("node", "_block", "_p", "_g"))
    w = Window.partitionBy("_block", "_g", "_band").orderBy("_p", "node")
    chain = (_banded(members).withColumn("_on", F.lead("node").over(w))
             .withColumn("_op", F.lead("_p").over(w))
             .filter(F.col("_on").isNotNull() & _close(F.col("_p"), F.col("_op")))
             .select(*_edge("node", "_on")))
    # an unpriced member matches every member, so the whole cell is one cluster
    hubs = (members.groupBy("_block", "_g")
            .agg(F.min("node").alias("hub"), F.bool_or(F.col("_p").isNull()).alias("any"))
            .filter("any").select("_block", "_g", "hub"))
    star = members.join(hubs, ["_block", "_g"]).filter("node <> hub").select(*_edge("node", "hub"))
    return chain.unionByName(star)


def _reach(lat: Column) -> Column:
    """Degrees of longitude that span the tolerance at a latitude; all of them next to a pole."""
    r = math.radians(_PLACE_DEG)
    return F.when(F.abs(F.radians(lat)) + r >= math.pi / 2, F.lit(360.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(r)) / F.cos(F.radians(lat))))))


def _cell_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of occupied cells of a block whose places may lie within the tolerance."""
    row, column = _grid(F.col("_lat"), F.col("_lon"))
    cells = cut(nodes.filter(F.col("_lat").isNotNull()).groupBy("_block", row.alias("r"), column.alias("c")).agg(
        *[f(x).alias(f"{n}{x}") for x in ("_lat", "_lon") for n, f in (("low", F.min), ("high", F.max))]))
    box = [c for c in cells.columns if c.startswith(("low", "high"))]
    south, north = F.col("low_lat") - _PLACE_DEG, F.col("high_lat") + _PLACE_DEG
    look = cells.withColumn("r2", F.explode(F.sequence(
        F.floor(south / F.lit(_CELL_DEG)).cast("bigint"), F.floor(north / F.lit(_CELL_DEG)).cast("bigint"))))
    wide = _reach(F.greatest(F.abs("low_lat"), F.abs("high_lat")))
    ends = [_grid((F.col("r2") + 0.5) * _CELL_DEG, x)[1] for x in (F.col("low_lon") - wide, F.col("high_lon") + wide)]
    look = (look.withColumn("c2", F.explode(F.sequence(*ends)))
            .filter((F.col("r2") > F.col("r")) | ((F.col("r2") == F.col("r")) & (F.col("c2") > F.col("c")))))
    other = cells.select(F.col("_block"), F.col("r").alias("r2"), F.col("c").alias("c2"),
                         *[F.col(c).alias(f"o{c}") for c in box])

    def gap(x: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"olow{x}") - F.col(f"high{x}"), F.col(f"low{x}") - F.col(f"ohigh{x}"))

    flat = F.cos(F.radians(F.greatest(*[F.abs(f"{n}_lat") for n in ("low", "high", "olow", "ohigh")])))
    near = (gap("_lat") <= _PLACE_DEG) & (
        flat * F.sin(F.radians(F.least(F.lit(90.0), gap("_lon")))) <= math.sin(math.radians(_PLACE_DEG)))
    return look.join(other, ["_block", "r2", "c2"]).filter(near).select("_block", "r", "c", "r2", "c2")


def _open_members(nodes: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the cell pairs that are not one component yet, with their side and label."""
    row, column = _grid(F.col("_lat"), F.col("_lon"))
    placed = (nodes.filter(F.col("_lat").isNotNull()).withColumns({"x": row, "y": column})
              .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    pair = F.struct("r", "c", "r2", "c2").alias("_g")
    sides = pairs.select("_block", pair, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("r").alias("x"), F.col("c").alias("y")),
        F.struct(F.lit(1).alias("side"), F.col("r2").alias("x"), F.col("c2").alias("y")))).alias("_s")).select(
        "_block", "_g", "_s.*")
    members = cut(sides.join(placed, ["_block", "x", "y"]).drop("x", "y"))
    open_ = (members.groupBy("_block", "_g").agg(F.min("label").alias("low"), F.max("label").alias("high"))
             .filter("low < high").select("_block", "_g"))
    return cut(members.join(open_, ["_block", "_g"], "left_semi"))


def _within(a: str = "", b: str = "_o") -> Column:
    return geo.haversine_m(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon")) <= GEO_TOLERANCE_M


def _witnesses(members: DataFrame) -> DataFrame:
    """Links between the sides of open cell pairs by one try per node: the next one in price.

    Where both sides are wholly within the tolerance this joins all that can be joined.
    """
    w = Window.partitionBy("_block", "_g", "_band").orderBy("_p", "node")
    ahead = F.lead(F.struct("node", "_p", "_lat", "_lon", "side")).over(w)
    priced = (_banded(members).withColumn("_n", ahead).filter("_n.side <> side")
              .withColumns({"_o_lat": F.col("_n._lat"), "_o_lon": F.col("_n._lon"), "_on": F.col("_n.node")})
              .filter(_close(F.col("_p"), F.col("_n._p")) & _within()).select(*_edge("node", "_on")))
    hubs = (members.filter(F.col("_p").isNull()).groupBy("_block", "_g", "side")
            .agg(F.min(F.struct("node", "_lat", "_lon")).alias("h")).withColumnRenamed("side", "_os"))
    unpriced = (members.join(hubs, ["_block", "_g"]).filter("side <> _os")
                .withColumns({"_o_lat": F.col("h._lat"), "_o_lon": F.col("h._lon"), "_on": F.col("h.node")})
                .filter(_within()).select(*_edge("node", "_on")))
    return priced.unionByName(unpriced)


def _remaining(members: DataFrame) -> DataFrame:
    """Links between different components of cell pairs that are still open, all of them tried."""
    one = members.filter("side = 0")
    two = members.filter("side = 1").select("_block", "_g", *[
        F.col(c).alias(f"_o{c}") for c in ("node", "_p", "_lat", "_lon", "label")])
    apart = (F.col("label") != F.col("_olabel")) & _within()
    priced = (_banded(one).join(_banded(two.withColumnRenamed("_o_p", "_p")).withColumnRenamed("_p", "_o_p"),
                                ["_block", "_g", "_band"]).filter(apart & _close(F.col("_p"), F.col("_o_p"))))
    free = F.col("_p").isNull() | F.col("_o_p").isNull()
    unpriced = one.join(two, ["_block", "_g"]).filter(free & apart)
    return priced.select(*_edge("node", "_onode")).unionByName(unpriced.select(*_edge("node", "_onode")))


def _place_links(nodes: DataFrame) -> DataFrame:
    """Links of located nodes: within cells, then between cells of what is not joined by them."""
    links = cut(_cell_links(nodes).distinct())
    pairs = cut(_cell_pairs(nodes))
    if pairs.isEmpty():
        return links
    for find in (_witnesses, _remaining):
        members = _open_members(nodes, pairs, connected_components(links, "a_id", "b_id"))
        if members.isEmpty():
            break
        links = cut(links.unionByName(find(members)).distinct())
    return links


def _unpriced_links(nodes: DataFrame) -> DataFrame:
    """Links of unpriced nodes across the block, through one hub per kind."""
    free, no_price = F.col("_lat").isNull(), F.col("_p").isNull()
    hubs = (nodes.groupBy("_block")
            .agg(F.min(F.when(free & no_price, F.col("node"))).alias("wild"),
                 F.min(F.when(free, F.col("node"))).alias("unlocated"),
                 F.min(F.when(~free & no_price, F.col("node"))).alias("unpriced"))
            .filter(F.col("wild").isNotNull() | F.col("unpriced").isNotNull()))
    ends = F.array(F.col("wild"), F.when(free, F.col("unpriced")),
                   F.when(no_price & ~free, F.col("unlocated")))
    return (nodes.join(hubs, "_block").select("node", F.explode(ends).alias("_on"))
            .filter("_on is not null and node <> _on").select(*_edge("node", "_on")))


def _nodes(blocked: DataFrame) -> DataFrame:
    return (blocked.groupBy("_block", "_p", "_lat", "_lon")
            .agg(F.min("listing_id").alias("node"), F.count("*").alias("_n")))


def _links(nodes: DataFrame) -> DataFrame:
    # most blocks hold a single node and cannot link
    several = nodes.groupBy("_block").count().filter("count > 1").select("_block")
    nodes = cut(nodes.drop("_n").join(several, "_block", "left_semi"))
    return (_unlocated_links(nodes).unionByName(_place_links(nodes))
            .unionByName(_unpriced_links(nodes)).filter("a_id <> b_id").distinct())


def duplicate_links(df: DataFrame, within: Sequence[str] = ("market",),
                    isolate_null_keys: bool = False) -> DataFrame:
    """Matching pairs (a_id < b_id) whose components are the duplicate clusters.

    Listings equal in block, price and place are one node, named by its smallest id.
    ``isolate_null_keys`` keeps listings without a postal code or street out of any block;
    by default missing parts compare equal.
    """
    return _links(cut(_nodes(_with_block(df, within, isolate_null_keys))))


def _large_blocks(blocked: DataFrame) -> tuple[int, DataFrame | None]:
    """Number of rows, and the hashes of blocks with more than ``SMALL_BLOCK`` of them.

    Blocks are counted only where a bucket of hashes holds so many rows.
    """
    bucket = F.pmod(F.col("_b1"), F.lit(_BUCKETS)).cast("int").alias("_bucket")
    counts = written(blocked.groupBy(bucket).agg(F.count("*").alias("n")), "block-buckets")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= SMALL_BLOCK:
        return total or 0, None
    full = counts.filter(F.col("n") > SMALL_BLOCK).select("_bucket")
    large = written(blocked.select("_b1", "_b2", bucket).join(full, "_bucket", "left_semi").groupBy("_b1", "_b2").count()
                    .filter(F.col("count") > SMALL_BLOCK).select("_b1", "_b2"), "large-blocks")
    return total, None if large.isEmpty() else large


def _same_cluster(first: np.ndarray, size: np.ndarray, rank: np.ndarray, p: np.ndarray, lat: np.ndarray,
                  lon: np.ndarray) -> np.ndarray:
    """Least rank of each row's cluster; rows of a block follow each other, NaN is missing.

    ``first`` and ``size`` are of the row's block. All pairs of a block are compared.
    """
    label, at = rank.copy(), np.arange(len(rank))
    later = first + size - 1 - at  # rows of the block behind this one
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    flat = np.cos(lat)
    some, step = np.flatnonzero(later > 0), 1
    while len(some):
        steps = max(1, _PAIRS // len(some))
        for step in range(step, step + steps):
            some = some[later[some] >= step]
            if not len(some):
                break
            i, j = some, some + step
            with np.errstate(invalid="ignore"):
                apart = np.abs(p[i] - p[j]) > PRICE_TOLERANCE * np.maximum(p[i], p[j])
                h = (np.sin((lat[j] - lat[i]) / 2) ** 2 + flat[i] * flat[j] * np.sin((lon[j] - lon[i]) / 2) ** 2)
                apart |= 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h))) > GEO_TOLERANCE_M
            ends.append((i[~apart], j[~apart]))
        step += 1
    if not ends:
        return label
    a, b = (np.concatenate(x) for x in zip(*ends))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if np.array_equal(before, label):
            return label


def _cluster_rows(columns: int):
    """Rows of small blocks, which follow each other, with the id of their cluster and whether it has several rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if left is None else [*left, batch])
            if not rows.num_rows:
                continue
            b1, b2 = (rows.column(c).to_numpy() for c in ("_b1", "_b2"))
            # the last block may go on in the next batch
            last = int(np.flatnonzero((b1 != b1[-1]) | (b2 != b2[-1]))[-1]) + 1 if (
                b1[0] != b1[-1] or b2[0] != b2[-1]) else 0
            left = rows.slice(last).combine_chunks().to_batches()
            if last:
                yield from clustered(rows.slice(0, last))
        if left:
            yield from clustered(pa.Table.from_batches(left))

    def clustered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        b1, b2 = (rows.column(c).to_numpy() for c in ("_b1", "_b2"))
        first = np.flatnonzero(np.concatenate(([True], (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))))
        size = np.diff(np.append(first, len(b1)))
        block = np.repeat(np.arange(len(first)), size)
        ids, known = rows.column("_id").combine_chunks(), rows.column("_id").is_valid().to_numpy()
        own = np.flatnonzero(size[block] > 1)
        cluster, several = np.arange(len(b1)), np.zeros(len(b1), bool)
        if len(own):
            # rows without an id name no cluster and join none
            own = own[known[own]]
            named = ids.take(pa.array(own))
            rank, order = np.empty(len(own), np.int64), pc.sort_indices(named).to_numpy()
            # equal ids have equal ranks
            text = named.take(pa.array(order))
            new = np.concatenate(([False], pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False))) if len(own) else []
            rank[order] = np.cumsum(new)
            _, start, inverse, count = np.unique(block[own], return_index=True, return_inverse=True, return_counts=True)
            p, lat, lon = (rows.column(c).to_numpy(zero_copy_only=False)[own].astype(np.float64) for c in ("_p", "_lat", "_lon"))
            label = _same_cluster(start[inverse], count[inverse], rank, p, np.radians(lat), np.radians(lon))
            holder = np.empty(len(own), np.int64)
            holder[rank[::-1]] = own[::-1]
            cluster[own] = holder[label]
            # a rank is a cluster of a block: the same id may name one in another block
            pair = np.stack([block[own], label])
            _, inverse, count = np.unique(pair, axis=1, return_inverse=True, return_counts=True)
            several[own] = count[inverse.ravel()] > 1
        out = pa.Table.from_arrays([*rows.columns[:columns], ids.take(pa.array(cluster)), pa.array(several)],
                                   names=[*rows.column_names[:columns], "cluster_id", SEVERAL])
        yield from out.to_batches(max_chunksize=10_000)
    return run


def dedup_clusters(df: DataFrame, within: Sequence[str] = ("market",),
                   isolate_null_keys: bool = False, mark: bool = False,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``cluster_id``, the smallest listing id of the duplicate cluster.

    ``mark`` adds ``SEVERAL`` too: whether the cluster has more than one row; and ``LARGE``: whether
    its block has more than ``SMALL_BLOCK``. ``columns`` of ``df`` are kept, all by default.
    """
    columns = list(columns or df.columns)
    blocked = _with_block(df, within, isolate_null_keys).withColumns(
        {"_b1": F.xxhash64("_block"), "_b2": F.hash("_block")})
    n_rows, large = _large_blocks(blocked)
    small = blocked if large is None else blocked.join(large, ["_b1", "_b2"], "left_anti")
    tasks = max(-(-n_rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    small = (small.select(*columns, "_b1", "_b2", F.col("listing_id").cast("string").alias("_id"), "_p",
                          F.col("_lat").cast("double").alias("_lat"), F.col("_lon").cast("double").alias("_lon"))
             .repartition(tasks, "_b1", "_b2").sortWithinPartitions("_b1", "_b2"))
    schema = StructType([*[df.schema[c] for c in columns], StructField("cluster_id", StringType()),
                         StructField(SEVERAL, BooleanType())])
    out = small.mapInArrow(_cluster_rows(len(columns)), schema).withColumn(LARGE, F.lit(False))
    if large is not None:
        own = _linked_clusters(blocked.join(large, ["_b1", "_b2"], "left_semi").select(
            *dict.fromkeys([*columns, "listing_id"]), "_block", "_p", "_lat", "_lon"))
        out = out.unionByName(own.select(*columns, "cluster_id", SEVERAL, F.lit(True).alias(LARGE)))
    return out if mark else out.drop(SEVERAL, LARGE)


def _linked_clusters(blocked: DataFrame) -> DataFrame:
    """The same with ``SEVERAL``, by the links of nodes; a block of any size is in no single task."""
    # written once: the links read the nodes many times, the listings only twice
    all_nodes = cut(_nodes(blocked))
    labels = connected_components(_links(all_nodes), "a_id", "b_id")
    # roots of components have no row of their own in the labels
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    nodes = (all_nodes.join(labels, "node", "left")
             .select(F.col("_block").alias("k1"), F.col("_p").alias("k2"),
                     F.col("_lat").alias("k3"), F.col("_lon").alias("k4"),
                     F.coalesce("label", "node").alias("cluster_id"),
                     (F.col("label").isNotNull() | (F.col("_n") > 1)).alias(SEVERAL)))
    cond = ((F.col("_block") == F.col("k1")) & F.col("_p").eqNullSafe(F.col("k2"))
            & F.col("_lat").eqNullSafe(F.col("k3")) & F.col("_lon").eqNullSafe(F.col("k4")))
    return (blocked.join(nodes, cond)
            .drop("_block", "_p", "_lat", "_lon", "k1", "k2", "k3", "k4"))


# -- survive -----------------------------------------------------------------
def with_priority(df: DataFrame, priority: DataFrame) -> DataFrame:
    """Add ``source_weight`` from a (source, weight) table; unknown sources weigh 0."""
    p = priority.select(F.col("source").alias("_ps"), F.col("weight").alias("_pw"))
    return (df.join(p, df["source"] == p["_ps"], "left")
            .withColumn("source_weight", F.coalesce(F.col("_pw"), F.lit(0.0))).drop("_ps", "_pw"))


def priority_table(df_session, weights: Mapping[str, float]) -> DataFrame:
    """(source, weight) table from a mapping, one row per configured source."""
    return df_session.createDataFrame([(k, float(v)) for k, v in weights.items()],
                                      "source string, weight double")


def _tie_order(df: DataFrame) -> list[Column]:
    """Total order of rows that tie: times, url, id, price, then a hash of the whole row."""
    late = F.lit("9999-12-31T00:00:00")
    order = [F.coalesce(F.col("scraped_at").cast("string"), late)] if "scraped_at" in df.columns else []
    order += [F.coalesce("url", F.lit("￿")), F.col("listing_id")]
    if "price" in df.columns:
        order.append(F.coalesce(F.col("price").cast("double"), F.lit(float("inf"))))
    return [*order, F.xxhash64(*[c for c in sorted(df.columns) if c not in ("cluster_id", SEVERAL, LARGE)])]


def resolve_clusters(df: DataFrame, columns: Sequence[str],
                     coalesce_fields: bool = True) -> DataFrame:
    """One row per cluster: the fullest record, its gaps filled from its duplicates.

    ``df`` needs ``cluster_id`` and ``source_weight``. Ties go to the heavier source, then
    to scraped_at, url, listing_id, price. Gaps are filled from the heaviest source that has a
    value. Everything is one combinable aggregation, so a cluster of any size never sits
    in one task. Where ``df`` has the marks of :func:`dedup_clusters`, rows that are alone in their
    cluster stay where they are, and clusters of small blocks are sorted by a window: the aggregation
    holds the keys of all columns, which are many times the row.
    """
    columns, kind = list(columns), dict(df.dtypes)
    filled = df.withColumn("_filled", count_filled(columns))
    tie = _tie_order(df)
    best = [-F.col("_filled"), -F.col("source_weight"), *tie]
    fill = [-F.col("source_weight"), *tie]

    def value(c: str, own: Column, other: Column | None) -> Column:
        if not coalesce_fields:
            return own.alias(c)
        own = F.nullif(own, F.lit("")) if kind[c] == "string" else own
        return (own if other is None else F.coalesce(own, other)).alias(c)

    def present(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    def combined(rows: DataFrame) -> DataFrame:
        aggs = [F.min_by(F.struct(*columns), F.struct(*best)).alias("_best"), F.count("*").alias("cluster_size")]
        if coalesce_fields:
            # an absent value ranks behind every present one and contributes NULL
            aggs += [F.min_by(F.when(present(c), F.col(c)), F.when(present(c), F.struct(*fill))).alias(f"_fill_{c}")
                     for c in columns]
        return rows.groupBy("cluster_id").agg(*aggs).select("cluster_id", "cluster_size", *[
            value(c, F.col(f"_best.{c}"), F.col(f"_fill_{c}") if coalesce_fields else None) for c in columns])

    def sorted_(rows: DataFrame) -> DataFrame:
        one = Window.partitionBy("cluster_id")
        whole = (Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("cluster_size", F.count("*").over(one))
        if coalesce_fields:
            rows = rows.withColumns({f"_fill_{c}": F.first(F.when(present(c), F.col(c)), True).over(
                one.orderBy(*fill).rowsBetween(*whole)) for c in columns})
        return rows.withColumn("_rn", F.row_number().over(one.orderBy(*best))).filter("_rn = 1").select(
            "cluster_id", "cluster_size", *[
                value(c, F.col(c), F.col(f"_fill_{c}") if coalesce_fields else None) for c in columns])

    if SEVERAL not in df.columns or LARGE not in df.columns:
        return combined(filled)
    # an id that stands in two blocks names one cluster all the same
    again = written(df.groupBy("cluster_id").agg(F.count("*").alias("n"), F.bool_and(SEVERAL).alias("all"))
                    .filter("n > 1 and not all").select("cluster_id"), "repeated-ids")
    repeated = None
    if not again.isEmpty():
        repeated = combined(filled.join(again, "cluster_id", "left_semi"))
        filled = filled.join(again, "cluster_id", "left_anti")
    alone = filled.filter(~F.col(SEVERAL)).select(
        "cluster_id", F.lit(1).cast("bigint").alias("cluster_size"), *[value(c, F.col(c), None) for c in columns])
    several = filled.filter(SEVERAL)
    out = alone.unionByName(sorted_(several.filter(~F.col(LARGE)))).unionByName(combined(several.filter(LARGE)))
    return out if repeated is None else out.unionByName(repeated)


def dedupe(df: DataFrame, priority: DataFrame, columns: Sequence[str] | None = None,
           within: Sequence[str] = ("market",), isolate_null_keys: bool = False) -> DataFrame:
    """Full resolution: one coalesced row per duplicate cluster."""
    columns = list(columns or df.columns)
    used = dict.fromkeys([*columns, *(c for c in ("scraped_at", "url", "listing_id", "price", "source") if c in df.columns)])
    clustered = with_priority(dedup_clusters(df, within, isolate_null_keys, mark=True, columns=used), priority)
    return resolve_clusters(clustered, columns)


def dedup_report(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Input and kept counts per source, with the grand total in row ``(all)``."""
    tagged = (df.select("source", F.lit(1).alias("i"), F.lit(0).alias("k"))
              .unionByName(kept.select("source", F.lit(0).alias("i"), F.lit(1).alias("k"))))
    return (tagged.rollup("source")
            .agg(F.grouping("source").alias("_g"), F.sum("i").alias("n_input"),
                 F.sum("k").alias("n_kept"))
            .select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col("source"))
                    .alias("source"), "n_input", "n_kept",
                    (F.col("n_input") - F.col("n_kept")).alias("n_removed")))
