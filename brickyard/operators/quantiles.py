"""Exact medians, quantiles and percentile ranks without a task that holds a group.

Built-in exact ``median``/``percentile`` keep every distinct value of a group in one
aggregation buffer, and a rank window without a fine partition puts a market into one
task. Both jobs here work on a histogram of order-preserving bins instead: counting bins
is a plain partial aggregation, the running total over bins is bounded by the number of
bins, and only the values of a single bin are ever sorted together. A hot group (or a hot
value, which collapses to one counted row) therefore spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.session import cut

BINS_PER_E = 4096
BROADCAST_ROWS = 100_000
GROUP_ROWS = 4_096  # up to so many rows a group is sorted as one array


def value_bin(v: Column) -> Column:
    """Order-preserving integer bin; about 1/4096 relative width away from zero."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * F.lit(float(BINS_PER_E)))).cast("bigint")


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def group_quantiles(df: DataFrame, keys: Sequence[str],
                    wanted: Mapping[str, tuple[Column, float]],
                    count_as: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any group size.

    ``wanted`` maps an output column to (value column, probability). NULL and NaN values
    are left out. ``count_as`` adds the number of values of the first wanted column.
    Groups without any value are absent, except that no keys give exactly one row when
    there is data.
    """
    keys = list(keys)
    # one metric per distinct value column
    metrics: list[Column] = []
    specs: list[tuple[str, int, float]] = []
    seen: dict[str, int] = {}
    for out, (col, p) in wanted.items():
        text = str(col)
        if text not in seen:
            seen[text] = len(metrics)
            metrics.append(col.cast("double"))
        specs.append((out, seen[text], p))

    df = df.select(*keys, *[m.alias(f"_m{i}") for i, m in enumerate(metrics)])
    if not keys:
        return _histogram_quantiles(df, keys, specs, count_as)
    # small groups, often most of them, take one shuffle; sizes are counted before by key alone
    sizes = cut(df.groupBy(*keys).agg(F.count("*").alias("_rows")))
    large = sizes.filter(F.col("_rows") > GROUP_ROWS).select(
        *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    n_large = large.count()
    if n_large == 0:
        return _array_quantiles(df, keys, specs, count_as)
    if n_large == sizes.count():
        return _histogram_quantiles(df, keys, specs, count_as)
    large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    same = _same(df, large, [(k, f"_h{i}") for i, k in enumerate(keys)])
    return _array_quantiles(df.join(large, same, "left_anti"), keys, specs, count_as).unionByName(
        _histogram_quantiles(df.join(large, same, "left_semi"), keys, specs, count_as))


def _array_quantiles(df: DataFrame, keys: list[str], specs: Sequence[tuple[str, int, float]],
                     count_as: str | None) -> DataFrame:
    """Quantiles of groups of at most ``GROUP_ROWS`` rows: a sorted array per group and metric."""
    used = sorted({m for _, m, _ in specs})
    values = {m: F.when(~F.isnan(f"_m{m}"), F.col(f"_m{m}")) for m in used}
    sorted_ = df.groupBy(*keys).agg(*[F.array_sort(F.collect_list(v)).alias(f"_a{m}")
                                      for m, v in values.items()])
    aggs = []
    for out, m, p in specs:
        a = F.col(f"_a{m}")
        at = (F.size(a) - 1).cast("double") * F.lit(p)
        low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
        frac = at - F.floor(at)
        aggs.append(F.when(frac == 0.5, (low + high) / 2).otherwise(low + (high - low) * frac).alias(out))
    if count_as:
        n = F.size(f"_a{specs[0][1]}").cast("bigint")
        aggs.append(F.nullif(n, F.lit(0).cast("bigint")).alias(count_as))
    known = F.lit(False)
    for m in used:
        known = known | (F.size(f"_a{m}") > 0)
    return sorted_.filter(known).select(*keys, *aggs)


def _histogram_quantiles(df: DataFrame, keys: list[str], specs: Sequence[tuple[str, int, float]],
                         count_as: str | None) -> DataFrame:
    """Quantiles of groups of any size by a histogram and the bins that hold the wanted ranks."""
    metrics = [F.col(f"_m{i}") for i in range(1 + max(m for _, m, _ in specs))]
    items = F.array(*[F.struct(F.lit(i).alias("m"), c.alias("v"))
                      for i, c in enumerate(metrics)])
    rows = (df.select(*keys, F.explode(items).alias("_x"))
            .select(*keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
            .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
            .withColumn("_bin", value_bin(F.col("_v"))))

    hist = rows.groupBy(*keys, "_m", "_bin").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys, "_m")
    running = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.withColumn("_hi", F.sum("_n").over(running))
            .withColumn("_lo", F.col("_hi") - F.col("_n"))
            .withColumn("_total", F.sum("_n").over(group)))

    def position(p: float) -> Column:
        return (F.col("_total") - 1).cast("double") * F.lit(p)

    # every wanted quantile needs the values at two ranks
    needs = F.array(*[
        F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"),
                 (fn(position(p)) - F.col("_lo")).cast("bigint").alias("off"),
                 (position(p) - F.floor(position(p))).alias("frac"), F.lit(m).alias("m"))
        for i, (_, m, p) in enumerate(specs)
        for side, fn in ((0, F.floor), (1, F.ceil))])
    needs = F.filter(needs, lambda x: (x["m"] == F.col("_m")) & (x["off"] >= 0)
                     & (x["off"] < F.col("_n")))
    hits = (hist.withColumn("_needs", needs).filter(F.size("_needs") > 0)
            .select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)],
                    F.col("_m").alias("_hm"), F.col("_bin").alias("_hbin"),
                    "_needs", "_total"))
    # at most two bins per wanted quantile and group; when they are few, the second pass
    # filters the rows where they are read instead of shuffling them
    hits = cut(hits)
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)

    pairs = [(k, f"_h{i}") for i, k in enumerate(keys)]
    cond = (_same(rows, hits, pairs) & (rows["_m"] == hits["_hm"])
            & (rows["_bin"] == hits["_hbin"]))
    in_bin = (rows.join(hits, cond).groupBy(*keys, "_m", "_bin", "_v")
              .agg(F.count("*").alias("_n"), F.any_value("_needs").alias("_needs"),
                   F.any_value("_total").alias("_total")))
    inside = (Window.partitionBy(*keys, "_m", "_bin").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, 0))
    picked = (in_bin.withColumn("_hi", F.sum("_n").over(inside))
              .withColumn("_x", F.explode("_needs"))
              .filter((F.col("_x.off") < F.col("_hi"))
                      & (F.col("_x.off") >= F.col("_hi") - F.col("_n"))))

    def at(q: int, side: int, field: str | Column) -> Column:
        return F.max(F.when((F.col("_x.q") == q) & (F.col("_x.side") == side), field))

    aggs = []
    for i, (out, _, _) in enumerate(specs):
        low, high = at(i, 0, F.col("_v")), at(i, 1, F.col("_v"))
        frac = at(i, 0, F.col("_x.frac"))
        aggs.append(F.when(frac == 0.5, (low + high) / 2)
                    .otherwise(low + (high - low) * frac).alias(out))
    if count_as:
        aggs.append(F.max(F.when(F.col("_x.q") == 0, F.col("_total"))).alias(count_as))
    out = picked.groupBy(*keys).agg(*aggs)
    return out if keys else out.filter(F.col(out.columns[0]).isNotNull())


def group_medians(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Column],
                  count_as: str | None = None) -> DataFrame:
    """Exact medians per group, see :func:`group_quantiles`."""
    return group_quantiles(df, keys, {k: (c, 0.5) for k, c in wanted.items()}, count_as)


def value_ranks(points: DataFrame, keys: Sequence[str], value: str,
                probes: DataFrame | None = None) -> DataFrame:
    """How many stored values of the group are <= each value.

    Returns one row per (keys, distinct value) with ``n_le`` and ``n_total``. Without
    ``probes`` the values are the stored ones; with it they are the values of ``probes``
    (same key and value column names), which need not be stored.
    """
    keys = list(keys)
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = (points.filter(known).groupBy(*keys, value)
              .agg(F.count("*").alias("_n"), F.lit(0).alias("_p")))
    if probes is not None:
        asked = (probes.filter(known).select(*keys, value).distinct()
                 .select(*keys, value, F.lit(0).cast("bigint").alias("_n"),
                         F.lit(1).alias("_p")))
        counts = (counts.unionByName(asked).groupBy(*keys, value)
                  .agg(F.sum("_n").alias("_n"), F.max("_p").alias("_p")))
    counts = counts.withColumn("_bin", value_bin(F.col(value).cast("double")))

    group = Window.partitionBy(*keys)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    before = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (bins.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
            .withColumn("n_total", F.sum("_bn").over(group))
            .select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)],
                    F.col("_bin").alias("_hbin"), "_before", "n_total"))
    cond = (_same(counts, bins, [(k, f"_h{i}") for i, k in enumerate(keys)])
            & (counts["_bin"] == bins["_hbin"]))
    inside = (Window.partitionBy(*keys, "_bin").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = counts.join(bins, cond).withColumn(
        "n_le", F.col("_before") + F.sum("_n").over(inside))
    if probes is not None:
        out = out.filter(F.col("_p") == 1)
    return out.select(*keys, value, "n_le", "n_total")


def with_percentile(df: DataFrame, points: DataFrame, keys: Sequence[str], value: str,
                    out: str, probe: str | None = None, digits: int | None = 1) -> DataFrame:
    """Add the percentile (0-100) of ``df.probe`` among ``points.value`` of its group.

    NULL, NaN and infinite values, and groups without points, get 50; such points do not count.
    """
    keys, probe = list(keys), probe or value
    finite = F.abs(F.col(value)) < float("inf")
    own = points is df and probe == value
    points = points.filter(finite)
    asked = None if own else df.select(*keys, F.col(probe).alias(value))
    ranks = value_ranks(points, keys, value, asked)
    ranks = ranks.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                         F.col(value).alias("_rv"), "n_le", "n_total")
    cond = _same(df, ranks, [(k, f"_r{i}") for i, k in enumerate(keys)]) & (
        df[probe] == ranks["_rv"])
    pct = F.col("n_le") * 100.0 / F.nullif(F.col("n_total"), F.lit(0))
    if digits is not None:
        scale = F.lit(float(10 ** digits))
        pct = F.rint(pct * scale) / scale
    return (df.join(ranks, cond, "left").withColumn(out, F.coalesce(pct, F.lit(50.0)))
            .drop(*[f"_r{i}" for i in range(len(keys))], "_rv", "n_le", "n_total"))
