"""Golden examples of the cleaning functions."""

from pyspark.sql import functions as F

from brickyard.functions import geo, text
from brickyard.operators import clean, enrich


def column(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_vocabularies(spark):
    types = column(spark, lambda c: text.map_vocabulary(c, text.PROPERTY_TYPES),
                   ["APARTMENT", "FLAT_STUDIO", "manor_house", "kot", "castle", None])
    assert types == ["flat", "flatStudio", "masterHouse", "studentFlat", None, None]
    states = column(spark, lambda c: text.map_vocabulary(c, text.BUILDING_STATES),
                    ["AS_NEW", "TO_RENOVATE", "good"])
    assert states == ["A", "D", "B"]
    assert column(spark, lambda c: text.map_vocabulary(c, text.KITCHENS),
                  ["HYPER_EQUIPPED"]) == ["Super equipped"]
    assert column(spark, lambda c: text.map_vocabulary(c, text.HEATINGS),
                  ["FUELOIL"]) == ["Fuel oil"]
    assert column(spark, text.epc_label, ["a+", " B ", "g", "A++ (12)", "BC", ""]) == [
        "A+", "B", "G", "A++", None, None]


def test_numbers(spark):
    assert column(spark, text.parse_price,
                  ["€ 849.000", "849000", "250000.00", "1.250,50", "gratis", "0", None]) == [
        849000.0, 849000.0, 250000.0, 1250.0, None, None, None]
    assert column(spark, text.parse_surface, ["85,5 m²", "85.5", "1.200 m2", "ca. 90 sqm", "-"]) == [
        85.5, 85.5, 1200.0, 90.0, None]
    assert column(spark, text.first_int, ["2.5", "3.5", "about 7 rooms", "", None]) == [2, 4, 7, None, None]
    assert column(spark, text.first_number, ["2.5", "x -1.5 y", "none"]) == [2.5, -1.5, None]
    assert column(spark, text.truthy_flag, ["yes", "Nee", "2", "0.0", "maybe", None]) == [
        1, 0, 1, 0, None, None]
    assert column(spark, text.postcode, ["B-9000 Gent", "12", None]) == ["9000", None, None]


def test_keys_and_addresses(spark):
    words = ["Crème Brûlée 12!", "Straße", "ŁÓDŹ", "ﬁn"]
    assert column(spark, text.norm_key, words)[:1] == ["cremebrulee12"]
    assert column(spark, text.norm_key_nfkd, words)[3] == "fin"
    rows = column(spark, text.split_address,
                  ["Kerkstraat 12A, 9000 Gent", "9000 Gent", "Kerkstraat 1", "Veldstraat, Gent", ""])
    assert [tuple(r) for r in rows] == [
        ("Kerkstraat", "12A", "9000", "Gent"), (None, None, "9000", "Gent"),
        ("Kerkstraat", "1", None, None), ("Veldstraat", None, None, "Gent"),
        (None, None, None, None)]


def test_flags_and_distance(spark):
    assert column(spark, clean.binary_flag, ["1", "0.4", "7", "-3", "x", None]) == [1, 0, 1, 0, 0, 0]
    d = column(spark, lambda c: geo.haversine_m(F.lit(50.0), F.lit(4.0), F.lit(50.0), c),
               [4.0, 5.0], "double")
    assert d[0] == 0.0 and abs(d[1] - 71474) < 50


def test_canonical_and_finalize(spark):
    raw = spark.createDataFrame(
        [("1", 1000.0, "x", "Liege", "flat", 849000.0, 85.0, float("nan"))],
        "listing_id string, postal_code double, terrace string, province string,"
        " property_type string, price double, livable_surface double, latitude double")
    row = clean.canonicalize(raw).first()
    assert row.postal_code == "1000" and row.terrace is None and row.province == "Liège"
    assert row.latitude is None and row.epc is None and len(row) == 44
    xw = spark.createDataFrame([(21004, "1000", None, "Bruxelles", "Brussels-Capital", "Brussels"),
                                (21015, "1000", "Schaarbeek", None, "Brussels-Capital", "Brussels")],
                               "refnis bigint, postal_code string, municipality_nl string,"
                               " municipality_fr string, province string, region string")
    done = enrich.finalize(clean.canonicalize(raw.drop("province")), xw).first()
    assert (done.category, done.price_per_sqm, done.refnis, done.region, done.province,
            done.municipality) == ("apartment", 9988.24, 21004, "Brussels", "Brussels", "Bruxelles")


def test_seen_urls(spark):
    seen = spark.createDataFrame([("a", "s")], "url string, source string")
    new = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "u"), (None, "u")],
                                "url string, source string")
    assert sorted(map(tuple, enrich.mark_seen(seen, new).collect())) == [("a", "s"), ("b", "t")]


def test_longer_postal_codes_stay_whole(spark):
    from brickyard.operators import enrich, extract

    xw = spark.createDataFrame(
        [(1, "1001", "Near", None, "P1", "R1"), (9016, "10016", "Far", None, "P2", "R2")],
        "refnis long, postal_code string, municipality_nl string, municipality_fr string, province string, region string")
    rows = spark.createDataFrame([("a", "B-10016"), ("b", "B-1001")], "listing_id string, postal_code string")
    got = {r.listing_id: (r.postal_code, r.refnis, r.municipality) for r in enrich.crosswalk_enrich(rows, xw).collect()}
    assert got == {"a": ("10016", 9016, "Far"), "b": ("1001", 1, "Near")}
    row = spark.range(1).select(
        text.split_address(F.lit("Veldstraat 12A, 10016 Far Away")).alias("a"),
        text.split_address(F.lit("10016 Far")).alias("b"),
        extract.url_meta(F.lit("https://x/detail/villa/for-sale/10016/far/1")).alias("u")).first()
    assert tuple(row.a) == ("Veldstraat", "12A", "10016", "Far Away")
    assert tuple(row.b) == (None, None, "10016", "Far")
    assert (row.u.postal_code, row.u.city) == ("10016", "Far")


def test_numbers_are_parsed_once(spark):
    """A parsed number does not repeat its own expression, and odd texts keep their values."""
    df = spark.createDataFrame([("1.234,50",)], "t string")
    for parse, calls in ((text.parse_price, 2), (text.parse_surface, 2)):
        plan = df.select(parse(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") <= calls, plan
    assert column(spark, text.parse_price, ["1.2.3", "0", "0.00", "12.", "1.234", "€ 85.5,9", None, "x"]) == [
        123.0, None, None, 12.0, 1234.0, 85.5, None, None]
    assert column(spark, text.parse_surface, ["1.234,5", "85.5,5", "1 200 m²", "m2 7", "0,0", None]) == [
        1234.5, None, 1200.0, 7.0, None, None]
    assert column(spark, text.first_number, ["about 3 rooms", " 7.5 ", "1e2", "-2 of 3", "", None]) == [
        3.0, 7.5, 100.0, -2.0, None, None]
