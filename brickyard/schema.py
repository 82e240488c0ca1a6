"""Canonical listing schema, model feature contract, vocabularies and bounds."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical listing record and the model's feature contract.
PROVENANCE = ["listing_id", "source", "url", "market", "scraped_at"]
GEO = ["street", "house_number", "postal_code", "locality", "municipality", "refnis",
       "province", "region", "latitude", "longitude", "nearest_city",
       "nearest_city_distance_km"]
NUMERIC = ["livable_surface", "land_surface", "bedrooms", "bathrooms", "toilets",
           "build_year", "facades", "number_of_floors", "primary_energy_consumption"]
CATEGORICAL = ["property_type", "category", "epc", "building_state", "kitchen_equipment",
               "heating_type"]
FLAGS = ["new_construction", "furnished", "terrace", "garden", "swimming_pool", "elevator",
         "cellar", "solar_panels", "air_conditioning", "has_parking"]
PRICE = ["price", "price_per_sqm"]

_TYPES = {
    **{c: T.StringType() for c in [*PROVENANCE, *GEO, *CATEGORICAL]},
    **{c: T.DoubleType() for c in [*NUMERIC, *PRICE, "latitude", "longitude",
                                   "nearest_city_distance_km"]},
    **{c: T.IntegerType() for c in FLAGS},
    "refnis": T.LongType(),
    "scraped_at": T.TimestampType(),
}
LISTING_COLUMNS = [*PROVENANCE, *GEO, *NUMERIC, *CATEGORICAL, *FLAGS, *PRICE]
LISTING_SCHEMA = T.StructType([T.StructField(c, _TYPES[c]) for c in LISTING_COLUMNS])

MODEL_NUMERIC = ["livable_surface", "bedrooms", "bathrooms", "toilets", "build_year",
                 "facades", "number_of_floors", "primary_energy_consumption",
                 "land_surface", "latitude", "longitude", "nearest_city_distance_km",
                 "neighbourhood_price_index"]
MODEL_CATEGORICAL = ["property_type", "province", "region", "epc", "building_state",
                     "kitchen_equipment", "heating_type"]
MODEL_FEATURES = [*MODEL_NUMERIC, *MODEL_CATEGORICAL, *FLAGS]

MARKETS = ("sale", "rent")
CATEGORIES = ("house", "apartment")

PROVINCE_FIX = {"Brussels-Capital": "Brussels", "Brussels Capital": "Brussels",
                "Liege": "Liège"}

# market -> (lowest, highest)
PPSQM_BOUNDS = {"sale": (400.0, 18_000.0), "rent": (3.0, 70.0)}
ROI_PRICE_BOUNDS = {"sale": (25_000.0, 15_000_000.0), "rent": (200.0, 25_000.0)}
TARGET_BOUNDS = {"sale": (25_000.0, 5_000_000.0), "rent": (200.0, 12_000.0)}
SURFACE_BOUNDS = (9.0, 3_000.0)

FEATURE_DEFAULTS = {
    "livable_surface": 120, "bedrooms": 2, "bathrooms": 1, "toilets": 1,
    "build_year": 1995, "facades": 2, "number_of_floors": 2,
    "primary_energy_consumption": 250, "land_surface": 0, "latitude": 50.85,
    "longitude": 4.35, "nearest_city_distance_km": 3, "neighbourhood_price_index": 50,
    "property_type": "house", "province": "Brussels", "region": "Brussels", "epc": "C",
    "building_state": "Normal", "kitchen_equipment": "Fully equipped",
    "heating_type": "Gas", **{f: 0 for f in FLAGS},
}

# province, latitude, longitude, region
PROVINCE_CENTROIDS = [
    ("Brussels", 50.845, 4.357, "Brussels"),
    ("Antwerp", 51.210, 4.410, "Flanders"),
    ("East Flanders", 51.020, 3.720, "Flanders"),
    ("West Flanders", 51.100, 3.150, "Flanders"),
    ("Flemish Brabant", 50.880, 4.700, "Flanders"),
    ("Limburg", 50.930, 5.340, "Flanders"),
    ("Walloon Brabant", 50.690, 4.450, "Wallonia"),
    ("Hainaut", 50.410, 4.010, "Wallonia"),
    ("Liège", 50.630, 5.570, "Wallonia"),
    ("Luxembourg", 49.910, 5.515, "Wallonia"),
    ("Namur", 50.465, 4.870, "Wallonia"),
]

EARTH_RADIUS_M = 6_371_000.0
