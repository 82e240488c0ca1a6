"""Canonical schema, guard rails and value cleaning for tables of listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard import schema as S
from brickyard.functions import money, text


def canonicalize(df: DataFrame, schema: T.StructType = S.LISTING_SCHEMA) -> DataFrame:
    """Select the canonical columns: missing ones NULL, extra ones dropped, bad values NULL.

    Text is trimmed with blanks as NULL, integer-valued numbers read as text lose their
    ``.0``, NaN becomes NULL, and the two known province spellings are unified.
    """
    have = dict(df.dtypes)
    out = []
    for field in schema.fields:
        name, kind = field.name, field.dataType
        if name not in have:
            c = F.lit(None).cast(kind)
        elif isinstance(kind, T.StringType):
            numeric = have[name] in ("double", "float")
            c = text.number_as_text(F.col(name)) if numeric else text.clean_string(F.col(name))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            v = F.col(name).try_cast(kind)
            c = F.when(~F.isnan(v), v)
        elif isinstance(kind, (T.IntegerType, T.LongType)):
            v = F.col(name).try_cast("double")
            c = F.when(~F.isnan(v), v).try_cast(kind)
        else:
            c = F.col(name).try_cast(kind)
        if name == "province":
            c = fix_province(c)
        out.append(c.alias(name))
    return df.select(*out)


def fix_province(c: Column) -> Column:
    """Unify the spellings of two provinces."""
    fixed = F.lit(None).cast("string")
    for bad, good in S.PROVINCE_FIX.items():
        fixed = F.coalesce(F.when(c == bad, good), fixed)
    return F.coalesce(fixed, c)


def _bounds(market: Column, value: Column, bounds: Mapping[str, tuple[float, float]]) -> Column:
    ok = F.lit(False)
    for name, (low, high) in bounds.items():
        ok = ok | ((market == name) & value.between(low, high))
    return ok


def ppsqm_guard(df: DataFrame) -> DataFrame:
    """Listings with coordinates and a plausible price per square metre."""
    v = F.col("price_per_sqm")
    return df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                     & _bounds(F.col("market"), v, S.PPSQM_BOUNDS))


def roi_guard(df: DataFrame) -> DataFrame:
    """Listings fit for yield tables; adds ``ppsqm``."""
    market, price, surface = F.col("market"), F.col("price"), F.col("livable_surface")
    return (df.filter(F.col("category").isin(*S.CATEGORIES)
                      & surface.between(*S.SURFACE_BOUNDS)
                      & _bounds(market, price, S.ROI_PRICE_BOUNDS))
            .withColumn("ppsqm", price / surface)
            .filter(_bounds(market, F.col("ppsqm"), S.PPSQM_BOUNDS)))


def target_guard(df: DataFrame) -> DataFrame:
    """Rows whose price is inside the constant bounds of its market."""
    return df.filter(_bounds(F.col("market"), F.col("price"), S.TARGET_BOUNDS))


def null_impossible(df: DataFrame) -> DataFrame:
    """Impossible feature values become NULL; columns not present are skipped."""
    checks = {
        "livable_surface": lambda v: v > 0, "land_surface": lambda v: v > 0,
        "primary_energy_consumption": lambda v: v.between(0, 1500),
        "build_year": lambda v: v.between(1750, 2031),
        "bedrooms": lambda v: v <= 15, "bathrooms": lambda v: v <= 15,
        "toilets": lambda v: v <= 15,
    }
    return df.withColumns({c: F.when(ok(F.col(c)), F.col(c))
                           for c, ok in checks.items() if c in df.columns})


def binary_flag(c: Column) -> Column:
    """Amenity flag: unreadable or missing is 0, clipped to 0..1, truncated."""
    v = F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return money.clip(v, 0.0, 1.0).cast("int")


def binary_flags(df: DataFrame, columns: Sequence[str] = S.FLAGS) -> DataFrame:
    return df.withColumns({c: binary_flag(F.col(c)) for c in columns if c in df.columns})


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] = S.FEATURE_DEFAULTS) -> DataFrame:
    """Missing features take the contract default; absent columns are added."""
    out = {}
    for name, value in defaults.items():
        typed = F.lit(float(value) if name in S.MODEL_NUMERIC else value)
        out[name] = F.coalesce(F.col(name), typed) if name in df.columns else typed
    return df.withColumns(out)


def usable(df: DataFrame) -> DataFrame:
    """Rows a comparable can be drawn from: price and coordinates known."""
    return df.dropna(subset=["price", "latitude", "longitude"])


def count_filled(columns: Sequence[str]) -> Column:
    """Number of columns that are neither NULL nor empty text."""
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0)
    return total


def missingness(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """The columns with the highest share of NULLs, in one pass over the table."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return (shares.unpivot([], list(columns), "column_name", "missing_share")
            .filter(F.col("missing_share") > 0)
            .orderBy(F.desc("missing_share"), "column_name").limit(top))


def clean_model_frame(df: DataFrame, id_col: str = "listing_id", also: Sequence[str] = ()) -> DataFrame:
    """Model table: one row per id, plausible target, cleaned features.

    The order of an id's rows ends in the columns that are returned, so no other column is read,
    joined or shuffled. Rows that tie in all of them are equal in the result.
    """
    from brickyard.operators.dedup import first_per_key

    keep = [c for c in S.MODEL_FEATURES if c in df.columns]
    used = list(dict.fromkeys([id_col, "market", *keep, *also, "price"]))
    rows = df.select(*used, *[c for c in ("scraped_at",) if c not in used])
    ties = [c for c in sorted(used) if c not in (id_col, "scraped_at", "price")]
    out = first_per_key(rows, [id_col], [F.col(c).asc_nulls_last() for c in ("scraped_at", "price", *ties)])
    out = binary_flags(null_impossible(target_guard(out)))
    return out.select(id_col, "market", *keep, *also, "price")
