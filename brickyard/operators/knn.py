"""Exact nearest-neighbour join on a grid that adapts to the local density.

Plan, per group (market):

1. points and queries are counted in cells that hold about 16 x ``k`` / 9 points in the densest place,
   and in all greater sizes (each doubles the one below). A cell with queries takes the smallest size
   at which its 3 x 3 cells hold ``k`` points; the distance from the cell to the farthest corner of
   those bounds the ``k``-th distance of every query in it;
2. tiles are the greatest cells with at most ``TILE_ROWS`` points and queries. The bounds of a tile's
   cells make one box, which is little more than the tile. A query is sent to its tile with its
   row, a point to the tiles whose boxes hold it: mostly one. Tiles are few rows, so neither side is
   shuffled to find them;
3. a task finds the neighbours of a tile's queries. It packs points and queries into small boxes, and
   measures only points in boxes that a box of queries can reach. Pairs are neither written nor
   shuffled, nor are lists: they leave the task with the query's row. The queries of a crowded
   tile are split among tasks;
4. cells with more points than a tile holds keep the first ``k`` ids of a place only - no other
   listing there can be among anyone's ``k`` nearest - so a hot address is a few rows;
5. a query with too few points in the first sizes is far from all of them, and such a bound
   would be wide. It descends a pyramid of cells with their counts and the boxes of their
   points instead, and drops at each size what lies beyond its bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from brickyard.schema import EARTH_RADIUS_M
from brickyard.session import cut, written

LON_STRETCH = 1.5      # cells about as wide as high at 48 degrees
TILE_ROWS = 100_000    # points and queries of a tile
TASK_ROWS = 400_000    # of the tiles of a task
LEAF = 32              # points, and queries, of a box
CHUNK = 4096           # queries whose lists are built at once
BASE = 2               # sizes from the finest cell to those that are counted
_PROBE_DEG = 0.05
_FIRST_LEVELS = 5
_STEP = 3              # sizes between two levels of the pyramid


def finest_cell(points: DataFrame, keys: Sequence[str], k: int) -> float:
    """Cell height in degrees that suits the most places in one spot; one scalar is collected."""
    cell = [F.floor(F.col("_plat") / _PROBE_DEG), F.floor(F.col("_plon") / _PROBE_DEG)]
    places = F.approx_count_distinct(F.xxhash64("_plat", "_plon")).alias("n")
    top = points.groupBy(*keys, *cell).agg(places).agg(F.max("n")).first()[0] or 1
    width = 0.5 * _PROBE_DEG * math.sqrt(max(k, 9) / 9.0 / top)
    return min(max(width, 2e-6), 0.5)


def _cells(lat: Column, lon: Column, finest: float) -> tuple[Column, Column]:
    return (F.floor(lat / F.lit(finest)).cast("bigint"),
            F.floor(lon / F.lit(finest * LON_STRETCH)).cast("bigint"))


def _parent(c: str) -> Column:
    """Cell index at size ``lv`` of a finest-size index."""
    return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("lv"))).cast("bigint")


def _choose_level(asked: DataFrame, fine: DataFrame, keys: list[str], need: int, low: int,
                  high: int) -> DataFrame:
    """Smallest cell size in ``low..high`` whose 3 x 3 block holds ``need`` points, per cell."""
    sizes = F.explode(F.sequence(F.lit(low), F.lit(max(low, high))))
    counts = (fine.withColumn("lv", sizes)
              .groupBy(*keys, "lv", _parent("x0").alias("cx"), _parent("y0").alias("cy"))
              .agg(F.sum("n").alias("n")))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                                 for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    full = (counts.withColumn("_o", around)
            .groupBy(*keys, "lv", (F.col("cx") + F.col("_o.dx")).alias("cx"),
                     (F.col("cy") + F.col("_o.dy")).alias("cy"))
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= need).drop("n"))
    return (asked.select(*keys, "x0", "y0").distinct().withColumn("lv", sizes)
            .withColumns({"cx": _parent("x0"), "cy": _parent("y0")})
            .join(full, [*keys, "lv", "cx", "cy"])
            .groupBy(*keys, "x0", "y0").agg(F.min("lv").alias("lv")))


def _lists(pairs: DataFrame, by: list[str], need: int, carry: Sequence[str]) -> DataFrame:
    """``_nb``: the first ``need`` points of each query, ranked by the haversine term ``_a``."""
    w = Window.partitionBy(*by).orderBy("_a", "_pid")
    ranked = pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= need)
    metres = F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt("_a")))
    item = F.struct(F.col("_rn"), metres.alias("distance_m"), F.col("_pid").alias("id"),
                    *[F.col(f"_carry.{c}").alias(c) for c in carry])
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_nb"))


def _term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine term of places in radians."""
    up, right = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return up * up + F.cos(lat2) * F.cos(lat1) * right * right


def _angle(term: Column) -> Column:
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(term)))


def pyramid(pts: DataFrame, px: Column, py: Column, finest: float, keys: list[str]) -> tuple[DataFrame, int]:
    """Occupied cells of every ``_STEP``-th size: point count, centre and radius of what is inside.

    Radii are those of the box of the points, not of the cell, so a cluster is known tightly
    at any size. The greatest size has a few cells in all.
    """
    top = _STEP * math.ceil((math.ceil(math.log2(360.0 / finest)) + 1) / _STEP)
    fine = cut(pts.groupBy(*keys, px.alias("x0"), py.alias("y0")).agg(
        F.count("*").alias("n"), *[f(f"_p{c}").alias(f"{n}_{c}") for c in ("lat", "lon")
                                   for n, f in (("low", F.min), ("high", F.max))]))
    sizes = F.explode(F.sequence(F.lit(0), F.lit(top), F.lit(_STEP)))
    cells = (fine.withColumn("lv", sizes)
             .groupBy(*keys, "lv", _parent("x0").alias("cx"), _parent("y0").alias("cy"))
             .agg(F.sum("n").alias("n"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("lat", "lon")
                                           for n, f in (("low", F.min), ("high", F.max))]))
    low, high = [[F.radians(f"{n}_{c}") for c in ("lat", "lon")] for n in ("low", "high")]
    lat, lon = (low[0] + high[0]) / 2, (low[1] + high[1]) / 2
    # of a box in degrees, the places farthest from its centre are corners
    radius = F.greatest(*[_angle(_term(lat, lon, x, high[1])) for x in (low[0], high[0])]) * 1.000001 + 1e-9
    return cut(cells.select(*keys, "lv", "cx", "cy", "n", lat.alias("clat"), lon.alias("clon"),
                            radius.alias("radius"))), top


def descend(far: DataFrame, cells: DataFrame, top: int, keys: list[str], need: int) -> DataFrame:
    """Finest cells that can hold one of a query's ``need`` nearest points, and its bound.

    Level by level: the bound is the smallest distance within which whole cells hold ``need``
    points; cells that lie beyond it are dropped, the others are replaced by theirs of the
    next size. What a query keeps is a few cells of each size around its bound.
    """
    at = far.join(cells.filter(F.col("lv") == top), keys)
    for size in range(top, -1, -_STEP):
        off = _angle(_term(F.radians("_qlat"), F.radians("_qlon"), F.col("clat"), F.col("clon")))
        at = at.withColumns({"_near": F.greatest(F.lit(0.0), off - F.col("radius")), "_far": off + F.col("radius")})
        upto = Window.partitionBy("_q").orderBy("_far", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)
        full = F.when(F.sum("n").over(upto) >= need, F.col("_far"))
        at = at.withColumn("_full", full).withColumn(
            "_bound", F.coalesce(F.min("_full").over(Window.partitionBy("_q")), F.lit(math.pi)) * 1.000001 + 1e-9)
        at = cut(at.filter(F.col("_near") <= F.col("_bound"))
                 .select(*keys, "_q", "_qlat", "_qlon", "cx", "cy", "_bound"))
        if size:
            scale = F.lit(float(2**_STEP))
            inner = (cells.filter(F.col("lv") == size - _STEP)
                     .withColumns({"ox": F.floor(F.col("cx") / scale).cast("bigint"),
                                   "oy": F.floor(F.col("cy") / scale).cast("bigint")}))
            at = (at.drop("_bound").withColumnsRenamed({"cx": "ox", "cy": "oy"})
                  .join(inner.drop("lv"), [*keys, "ox", "oy"]).drop("ox", "oy"))
    return at


def _far_lists(far: DataFrame, pts: DataFrame, px: Column, py: Column, finest: float, keys: list[str],
               need: int, carry: Sequence[str]) -> DataFrame:
    """Neighbour lists of queries far from all points, by branch and bound."""
    cells, top = pyramid(pts, px, py, finest, keys)
    far = cut(far.select(*keys, "_qlat", "_qlon", F.monotonically_increasing_id().alias("_q")))
    reach = descend(far, cells, top, keys, need)
    at = pts.withColumns({"cx": px, "cy": py})
    term = _term(F.radians("_qlat"), F.radians("_qlon"), F.radians("_plat"), F.radians("_plon"))
    pairs = (reach.join(at, [*keys, "cx", "cy"]).withColumn("_a", term)
             .filter(_angle(F.col("_a")) <= F.col("_bound")).select("_q", "_a", "_pid", "_carry"))
    return _lists(pairs, ["_q"], need, carry).join(far, "_q").select(*keys, "_qlat", "_qlon", "_nb")


def _reach(size: float) -> dict[str, Column]:
    """Box in degrees that holds the ``need`` nearest points of every query in a cell of size ``lv``."""
    g, up = F.lit(size) * F.pow(F.lit(2.0), F.col("lv")), LON_STRETCH
    south, west = F.col("x0") * F.lit(size), F.col("y0") * F.lit(size * up)
    north, east = south + F.lit(size), west + F.lit(size * up)
    high = F.radians(F.greatest(north - (_parent("x0") - 1) * g, (_parent("x0") + 2) * g - south))
    wide = F.radians(F.greatest(east - (_parent("y0") - 1) * g * up, (_parent("y0") + 2) * g * up - west))
    most = F.radians(F.greatest(F.abs(south), F.abs(north)))
    flat = F.cos(F.greatest(F.lit(0.0), most - F.lit(math.radians(size)) - high))
    r = F.least(F.hypot(high, wide * flat) * 1.000001 + 1e-12, F.lit(math.pi))
    dlon = F.when(most + r >= math.pi / 2, F.lit(360.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(r) / F.cos(most)))))
    dlat = F.least(F.degrees(r), F.lit(180.0))
    slack = 1e-9
    return {"lat1": south - dlat - slack, "lat2": north + dlat + slack, "lon1": west - dlon - slack, "lon2": east + dlon + slack}


def _tiles(cells: DataFrame, keys: list[str], size: float, top: int) -> DataFrame:
    """``tl``, ``tx``, ``ty`` of the greatest cells with at most ``TILE_ROWS`` points and queries."""
    sizes = F.explode(F.sequence(F.lit(0), F.lit(top)))
    full = (cells.withColumn("lv", sizes)
            .groupBy(*keys, "lv", _parent("x0").alias("cx"), _parent("y0").alias("cy"))
            .agg(F.sum(F.col("np") + F.col("nq")).alias("rows")).filter(F.col("rows") > TILE_ROWS)
            .select(*keys, F.col("lv").alias("fl"), "cx", "cy"))
    full = written(full, "knn-full")
    at = (cells.filter("nq > 0").withColumn("lv", sizes).withColumns({"cx": _parent("x0"), "cy": _parent("y0")}))
    # the least size that is too full, less one, is the greatest that is not
    held = (at.withColumn("fl", F.col("lv")).join(full, [*keys, "fl", "cx", "cy"])
            .groupBy(*keys, "x0", "y0").agg(F.min("lv").alias("_f")))
    return (cells.filter("nq > 0").join(held, [*keys, "x0", "y0"], "left")
            .withColumn("tl", F.coalesce(F.greatest(F.col("_f") - 1, F.lit(0)), F.lit(top))).drop("_f")
            .withColumns({f"t{c}": F.expr(f"shiftright({c}0, tl)") for c in "xy"}))


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    flat = np.cos(lat)
    return np.stack([flat * np.cos(lon), flat * np.sin(lon), np.sin(lat)])


def _packed(xyz: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of places by boxes of ``LEAF``, in strips of latitude; least and greatest coordinates of the boxes."""
    n = len(lat)
    strip = math.ceil(math.sqrt(n / LEAF)) * LEAF
    number = np.empty(n, np.int64)
    number[np.argsort(lat, kind="stable")] = np.arange(n) // strip
    order = np.lexsort((lon, number))
    first = np.arange(0, n, LEAF)
    own = xyz[:, order]
    return order, np.minimum.reduceat(own, first, axis=1), np.maximum.reduceat(own, first, axis=1)


_EDGE = 4e-15  # of rounding, in radii of the earth


def _found(p_lat: np.ndarray, p_lon: np.ndarray, rank: np.ndarray, q_lat: np.ndarray, q_lon: np.ndarray, need: int):
    """(queries, points, terms) of some queries at once: their ``need`` nearest points, those of equal terms by rank."""
    p, q = _unit(p_lat, p_lon), _unit(q_lat, q_lon)
    p_by, p_low, p_high = _packed(p, p_lat, p_lon)
    q_by, q_low, q_high = _packed(q, q_lat, q_lon)
    p, n = p[:, p_by], len(p_by)
    boxes, full = p_low.shape[1], n // LEAF
    m = math.ceil(need / LEAF)  # any so many full boxes hold enough
    inside = np.arange(LEAF)
    for a in range(0, q_low.shape[1], CHUNK // LEAF):
        z = slice(a, a + CHUNK // LEAF)
        low, high = q_low[:, z, None], q_high[:, z, None]
        near = sum(np.maximum(0.0, np.maximum(p_low[d] - high[d], low[d] - p_high[d])) ** 2 for d in range(3))
        limit = np.full(near.shape[0], np.inf)
        if full >= m:
            far = sum(np.maximum(p_high[d, :full] - low[d], high[d] - p_low[d, :full]) ** 2 for d in range(3))
            limit = np.partition(far, m - 1, axis=1)[:, m - 1]
        reach = near <= (np.sqrt(limit)[:, None] + _EDGE) ** 2
        start, stop = a * LEAF, min((a + reach.shape[0]) * LEAF, len(q_by))
        own = q_by[start:stop]
        rows, points = [], []
        for b in range(reach.shape[0]):
            at = (np.flatnonzero(reach[b])[:, None] * LEAF + inside).ravel()
            if at[-1] >= n:
                at = at[at < n]
            mine = own[b * LEAF:(b + 1) * LEAF]
            d = (q[0, mine, None] - p[0, at]) ** 2
            d += (q[1, mine, None] - p[1, at]) ** 2
            d += (q[2, mine, None] - p[2, at]) ** 2
            if len(at) > need:
                last = np.partition(d, need - 1, axis=1)[:, need - 1]
                i, j = np.nonzero(d <= ((np.sqrt(last) + _EDGE) ** 2)[:, None])
            else:
                i, j = (x.ravel() for x in np.indices(d.shape))
            rows.append(i + b * LEAF)
            points.append(at[j])
        row, point = np.concatenate(rows), p_by[np.concatenate(points)]
        i = own[row]
        term = (np.sin((p_lat[point] - q_lat[i]) / 2) ** 2
                + np.cos(p_lat[point]) * np.cos(q_lat[i]) * np.sin((p_lon[point] - q_lon[i]) / 2) ** 2)
        by = np.lexsort((rank[point], term, row))
        count = np.bincount(row, minlength=len(own))
        by = by[np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count) < need]
        yield own, row[by], point[by], term[by]


class Brief(NamedTuple):
    """What to return of a list instead of its elements."""

    value: str          # carried column: its median is ``local_<value>``
    near_m: float       # ``n_near`` counts the neighbours within it
    first: str          # carried column of the nearest point, ``nearest_<first>``

    def fields(self, points: DataFrame, point_id: str) -> list[StructField]:
        return [StructField(f"local_{self.value}", DoubleType()), StructField("radius_m", DoubleType()),
                StructField("n_near", IntegerType()), StructField("n_neighbours", IntegerType()),
                StructField("nearest_id", points.schema[point_id].dataType),
                StructField(f"nearest_{self.first}", points.schema[self.first].dataType)]

    def of(self, nb: Column) -> dict[str, Column]:
        return {f"local_{self.value}": array_median(F.transform(nb, lambda x: x[self.value])),
                "radius_m": F.get(nb, F.size(nb) - 1)["distance_m"],
                "n_near": F.size(F.filter(nb, lambda x: x["distance_m"] <= self.near_m)),
                "n_neighbours": F.size(nb), "nearest_id": F.get(nb, F.lit(0))["id"],
                f"nearest_{self.first}": F.get(nb, F.lit(0))[self.first]}

    def arrays(self, count: np.ndarray, row: np.ndarray, point: np.ndarray, metres: np.ndarray, k: int,
               value: np.ndarray, ids: pa.Array, first: pa.Array) -> list[pa.Array]:
        """The columns of queries with ``count`` neighbours each, in order of ``row`` and distance."""
        start, some = np.cumsum(count) - count, count > 0
        table = np.full((len(count), k), np.inf)
        table[row, np.arange(len(row)) - start[row]] = value[point]
        table.sort(axis=1)
        every, last = np.arange(len(count)), np.maximum(count - 1, 0)
        middle = (table[every, last // 2] + table[every, np.minimum(count // 2, k - 1)]) / 2
        nearest = pa.array(point[start[some]])
        at = np.cumsum(some) - 1
        back = pa.array(at, mask=~some)
        radius = np.zeros(len(count))
        radius[some] = metres[(start + last)[some]]
        return [pa.array(middle, mask=~some), pa.array(radius, mask=~some),
                pa.array(np.bincount(row[metres <= self.near_m], minlength=len(count)), pa.int32()),
                pa.array(count, pa.int32()), ids.take(nearest).take(back), first.take(nearest).take(back)]


def _tile_lists(k: int, need: int, carry: Sequence[str], exclude: bool, columns: int, brief: Brief | None, schema: pa.Schema):
    """Rows of a tile's queries, of ``columns`` columns, with their ``neighbours`` or a brief of them."""
    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if points.num_rows and asked.num_rows:
            lat, lon, q_lat, q_lon = (np.radians(t.column(c).to_numpy()) for t, c in (
                (points, "_plat"), (points, "_plon"), (asked, "_qlat"), (asked, "_qlon")))
            ids = points.column("_pid").combine_chunks()
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            # of a place with many points, only the first ids can be found
            by = np.lexsort((rank, lon, lat))
            new = np.concatenate(([True], (lat[by][1:] != lat[by][:-1]) | (lon[by][1:] != lon[by][:-1])))
            place = np.arange(len(by)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            kept = np.sort(by[place < need])
            lat, lon, rank, points = lat[kept], lon[kept], rank[kept], points.take(pa.array(kept))
            ids = points.column("_pid").combine_chunks()
            fields = [ids, *(points.column(f"_c_{c}").combine_chunks() for c in carry)]
            if exclude:
                both = pa.chunked_array([ids, *asked.column("_self").chunks], ids.type).combine_chunks()
                code = pc.fill_null(both.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                p_code, q_code = code[:len(ids)], code[len(ids):]
            asked = asked.select(schema.names[:columns])
            if brief:
                value = fields[1 + carry.index(brief.value)].to_numpy(zero_copy_only=False).astype(np.float64)
            for own, row, point, term in _found(lat, lon, rank, q_lat, q_lon, need):
                if exclude:
                    other = p_code[point] != q_code[own[row]]
                    row, point, term = row[other], point[other], term[other]
                count = np.bincount(row, minlength=len(own))
                first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < k
                row, point, term, count = row[first], point[first], term[first], np.minimum(count, k)
                metres = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(term)))
                rows = asked.take(pa.array(own)).combine_chunks()
                if brief:
                    added = brief.arrays(count, row, point, metres, k, value, ids, fields[1 + carry.index(brief.first)])
                else:
                    item, at = schema.field(columns).type.value_type, pa.array(point)
                    added = [pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.StructArray.from_arrays(
                            [pa.array(metres), *(f.take(at) for f in fields)],
                            fields=[item.field(i) for i in range(item.num_fields)]))]
                out += pa.Table.from_arrays([*rows.columns, *added], names=schema.names).to_batches()
        return pa.Table.from_batches(out).cast(schema) if out else schema.empty_table()
    return run


def nearest(queries: DataFrame, points: DataFrame, k: int, *, keys: Sequence[str] = ("market",),
            point_id: str = "listing_id", carry: Sequence[str] = (),
            exclude_id: str | None = None, finest: float | None = None, brief: Brief | None = None) -> DataFrame:
    """Add ``neighbours``: the ``k`` nearest points as an array ordered by distance, id.

    Both tables have ``latitude``/``longitude`` and the ``keys``. Elements hold
    ``distance_m``, ``id`` and the ``carry`` columns of the point. With ``exclude_id`` the
    point of that id is left out (leave-one-out). Queries without coordinates, or without
    any point in their group, get NULL. Both tables are read several times. With ``brief`` its columns
    are added instead of the array.
    """
    keys, need, columns, carry = list(keys), k + (1 if exclude_id else 0), queries.columns, list(carry)
    known = F.lit(True)
    for c in ("latitude", "longitude", *keys):
        known = known & F.col(c).isNotNull()
    pts = points.filter(known).select(
        *keys, F.col("latitude").cast("double").alias("_plat"), F.col("longitude").cast("double").alias("_plon"),
        F.col(point_id).alias("_pid"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    asked = queries.filter(known).withColumns({"_qlat": F.col("latitude").cast("double"),
                                               "_qlon": F.col("longitude").cast("double")})
    item = StructType([StructField("distance_m", DoubleType()), StructField("id", points.schema[point_id].dataType),
                       *[StructField(c, points.schema[c].dataType) for c in carry]])
    lists = ArrayType(item)
    schema = StructType([*queries.schema, *(brief.fields(points, point_id) if brief else [StructField("neighbours", lists)])])
    finest = finest or finest_cell(pts, keys, need)
    size = finest * 2**BASE

    # points and queries by cell, and the size whose 3 x 3 block around a cell with queries holds enough points
    px, py = _cells(F.col("_plat"), F.col("_plon"), size)
    qx, qy = _cells(F.col("_qlat"), F.col("_qlon"), size)
    no, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    cells = written(pts.select(*keys, px.alias("x0"), py.alias("y0"), one.alias("np"), no.alias("nq")).unionByName(
        asked.select(*keys, qx.alias("x0"), qy.alias("y0"), no.alias("np"), one.alias("nq")))
        .groupBy(*keys, "x0", "y0").agg(F.sum("np").alias("np"), F.sum("nq").alias("nq")), "knn-cells")
    top = math.ceil(math.log2(360.0 / size)) + 1
    first = min(_FIRST_LEVELS, top)
    chosen = _choose_level(cells.filter("nq > 0"), cells.filter("np > 0").withColumnRenamed("np", "n"), keys, need, 0, first)
    bounds = written(_tiles(cells, keys, size, top).join(chosen, [*keys, "x0", "y0"], "left"), "knn-bounds")

    # one row per tile; its box is looked up in cells of about its extent
    box = ["lat1", "lat2", "lon1", "lon2"]
    tile = [*keys, "tl", "tx", "ty"]
    tiles = (bounds.filter("lv is not null").withColumns(_reach(size)).groupBy(*tile)
             .agg(*[(F.min if c.endswith("1") else F.max)(c).alias(c) for c in box],
                  F.ceil(F.sum("nq") / TILE_ROWS).cast("bigint").alias("_parts")))
    spans = F.greatest(F.ceil((F.col("lat2") - F.col("lat1")) / size), F.ceil((F.col("lon2") - F.col("lon1")) / (size * LON_STRETCH)))
    tiles = written(tiles.withColumns({"il": F.least(F.ceil(F.log2(F.greatest(spans, F.lit(1.0)))), F.lit(top)).cast("int"),
                                       "_t": F.monotonically_increasing_id()}), "knn-tiles")
    tls, ils = tiles.agg(F.collect_set("tl"), F.collect_set("il")).first()  # sizes in use
    found = []
    far = bounds.filter("lv is null").select(*keys, "x0", "y0")
    if far.isEmpty():
        far = None
    if tls:
        wide = F.lit(size) * F.pow(F.lit(2.0), F.col("il"))
        reach = written(tiles.withColumn("ix", F.explode(F.sequence(
            F.floor(F.col("lat1") / wide).cast("bigint"), F.floor(F.col("lat2") / wide).cast("bigint"))))
            .withColumn("iy", F.explode(F.sequence(
                F.floor(F.col("lon1") / (wide * LON_STRETCH)).cast("bigint"),
                F.floor(F.col("lon2") / (wide * LON_STRETCH)).cast("bigint"))))
            .select(*keys, "il", "ix", "iy", *box, "_parts", "_t"), "knn-reach")
        inside = (F.col("_plat").between(F.col("lat1"), F.col("lat2"))
                  & F.col("_plon").between(F.col("lon1"), F.col("lon2")))
        near = (_collapsed(pts, cells, px, py, keys, need)
                .withColumn("il", F.explode(F.array(*map(F.lit, sorted(ils)))))
                .withColumns({"ix": F.floor(F.col("_plat") / wide).cast("bigint"),
                              "iy": F.floor(F.col("_plon") / (wide * LON_STRETCH)).cast("bigint")})
                .join(reach, [*keys, "il", "ix", "iy"]).filter(inside)
                .withColumn("_part", F.explode(F.sequence(no, F.col("_parts") - 1)))
                .select("_t", "_part", "_plat", "_plon", "_pid", *[f"_c_{c}" for c in carry]))
        mine = asked.withColumns({"_x": qx, "_y": qy})
        if far is not None:
            mine = mine.join(far.withColumnsRenamed({"x0": "_x", "y0": "_y"}), [*keys, "_x", "_y"], "left_anti")
        mine = (mine.withColumn("tl", F.explode(F.array(*map(F.lit, sorted(tls)))))
                .withColumns({f"t{c}": F.expr(f"shiftright(_{c}, tl)") for c in "xy"})
                .join(tiles.select(*tile, "_t", "_parts"), tile))
        part = F.pmod(F.xxhash64("_qlat", "_qlon", *([exclude_id] if exclude_id else [])), F.col("_parts"))
        mine = mine.select("_t", part.alias("_part"), *columns, "_qlat", "_qlon",
                           *([F.col(exclude_id).alias("_self")] if exclude_id else []))
        n_rows = sum(cells.agg(F.sum("np"), F.sum("nq")).first())
        tasks = max(-(-n_rows // TASK_ROWS), queries.sparkSession.sparkContext.defaultParallelism)
        found.append(near.repartition(tasks, "_t", "_part").groupBy("_t", "_part").cogroup(
            mine.repartition(tasks, "_t", "_part").groupBy("_t", "_part")).applyInArrow(
                _tile_lists(k, need, carry, exclude_id is not None, len(columns), brief, to_arrow_schema(schema)), schema))
    if far is not None:
        own = asked.withColumns({"_x": qx, "_y": qy}).join(
            far.withColumnsRenamed({"x0": "_x", "y0": "_y"}), [*keys, "_x", "_y"], "left_semi").drop("_x", "_y")
        found.append(_far_rows(own, pts, finest, keys, k, need, carry, exclude_id).select(*columns, "neighbours"))
        if brief:
            found[-1] = found[-1].withColumns(brief.of(F.col("neighbours"))).drop("neighbours")
    out = queries.filter(~known).withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields[len(columns):]})
    for rows in found:
        out = out.unionByName(rows)
    return out


def _collapsed(pts: DataFrame, cells: DataFrame, px: Column, py: Column, keys: list[str], need: int) -> DataFrame:
    """The points; of a place in a cell with more than a tile's, the first ``need`` ids."""
    crowded = written(cells.filter(F.col("np") > TILE_ROWS).select(*keys, "x0", "y0"), "knn-crowded")
    if crowded.isEmpty():
        return pts
    at, place = pts.withColumns({"x0": px, "y0": py}), Window.partitionBy(*keys, "_plat", "_plon").orderBy("_pid")
    hot = (at.join(crowded, [*keys, "x0", "y0"], "left_semi").withColumn("_rn", F.row_number().over(place))
           .filter(F.col("_rn") <= need).drop("_rn"))
    return at.join(crowded, [*keys, "x0", "y0"], "left_anti").unionByName(hot).drop("x0", "y0")


def _far_rows(far: DataFrame, pts: DataFrame, finest: float, keys: list[str], k: int, need: int,
              carry: Sequence[str], exclude_id: str | None) -> DataFrame:
    """Rows of queries far from all points with their neighbours."""
    place = Window.partitionBy(*keys, "_plat", "_plon").orderBy("_pid")
    pts = pts.select(*keys, "_plat", "_plon", "_pid", F.struct(
        *[F.col(f"_c_{c}").alias(c) for c in carry], F.lit(1).alias("_one")).alias("_carry"))
    pts = written(pts.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= need).drop("_rn"), "knn-places")
    px, py = _cells(F.col("_plat"), F.col("_plon"), finest)
    found = _far_lists(far.select(*keys, "_qlat", "_qlon").distinct(), pts, px, py, finest, keys, need, carry).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col("_qlat").alias("_fl"), F.col("_qlon").alias("_fo"), "_nb")
    cond = (F.col("_qlat") == F.col("_fl")) & (F.col("_qlon") == F.col("_fo"))
    for i, c in enumerate(keys):
        cond = cond & (F.col(c) == F.col(f"_k{i}"))
    out, nb = far.join(found, cond, "left"), F.col("_nb")
    if exclude_id:
        nb = F.filter(nb, lambda x: ~x["id"].eqNullSafe(F.col(exclude_id)))
    return out.withColumn("neighbours", F.transform(F.slice(nb, 1, k), lambda x: x.dropFields("_rn")))


def array_median(values: Column) -> Column:
    """Median of a short numeric array (mean of the middle two); NULL when empty."""
    s = F.array_sort(values)
    n = F.size(s)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)
