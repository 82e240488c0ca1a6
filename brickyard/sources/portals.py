"""Declarative mappings of the two JSON portals and of captured detail pages."""

from __future__ import annotations

from brickyard.operators.extract import SourceMapping

# Payload paths per canonical column and how reliably each field is filled.
PORTAL_ONE = SourceMapping(
    name="portal_one", markers=[("window.classified", "$"),
                                ("__NEXT_DATA__", "$.props.pageProps.classified")],
    paths={
        "listing_id": ["$.id"],
        "street": ["$.property.location.street"],
        "house_number": ["$.property.location.number"],
        "postal_code": ["$.property.location.postalCode"],
        "locality": ["$.property.location.locality"],
        "municipality": ["$.property.location.locality"],
        "province": ["$.property.location.province"],
        "region": ["$.property.location.region"],
        "latitude": ["$.property.location.latitude"],
        "longitude": ["$.property.location.longitude"],
        "property_type": ["$.property.subtype", "$.property.type"],
        "livable_surface": ["$.property.netHabitableSurface"],
        "land_surface": ["$.property.land.surface"],
        "bedrooms": ["$.property.bedroomCount"],
        "bathrooms": ["$.property.bathroomCount"],
        "toilets": ["$.property.toiletCount"],
        "build_year": ["$.property.building.constructionYear"],
        "facades": ["$.property.building.facadeCount"],
        "number_of_floors": ["$.property.building.floorCount"],
        "primary_energy_consumption": ["$.transaction.certificates.primaryEnergyConsumptionPerSqm"],
        "building_state": ["$.property.building.condition"],
        "kitchen_equipment": ["$.property.kitchen.type"],
        "heating_type": ["$.property.energy.heatingType"],
        "epc": ["$.transaction.certificates.epcScore"],
        "price": ["$.transaction.sale.price", "$.transaction.rental.monthlyRentalPrice"],
        "new_construction": ["$.transaction.sale.isNewlyBuilt", "$.flags.isNewlyBuilt"],
        "furnished": ["$.property.isFurnished"],
        "terrace": ["$.property.hasTerrace"],
        "garden": ["$.property.hasGarden"],
        "swimming_pool": ["$.property.hasSwimmingPool"],
        "elevator": ["$.property.hasLift"],
        "cellar": ["$.property.hasBasement"],
        "solar_panels": ["$.property.hasSolarPanels"],
        "air_conditioning": ["$.property.hasAirConditioning"],
    },
    parking_paths=("$.property.parkingCountIndoor", "$.property.parkingCountOutdoor"),
    completeness={
        "property_type": 1.0, "livable_surface": 0.95, "land_surface": 0.6, "bedrooms": 0.98,
        "bathrooms": 0.9, "toilets": 0.7, "build_year": 0.7, "facades": 0.8,
        "number_of_floors": 0.4, "primary_energy_consumption": 0.85, "epc": 0.9,
        "building_state": 0.7, "kitchen_equipment": 0.8, "heating_type": 0.7, "price": 1.0,
        "latitude": 0.85, "longitude": 0.85, "street": 0.8, "postal_code": 1.0, "terrace": 0.9,
        "garden": 0.9, "elevator": 0.8, "cellar": 0.7, "swimming_pool": 0.9, "has_parking": 0.7,
    })

PORTAL_TWO = SourceMapping(
    name="portal_two", markers=[('"estate":', "$"), ("window.__ESTATE__", "$"),
                                ('"@type":"Residence"', "$")],
    paths={
        "listing_id": ["$.id"],
        "street": ["$.geo.street", "$.location.street"],
        "house_number": ["$.geo.number", "$.location.number"],
        "postal_code": ["$.geo.zip", "$.geo.postalCode", "$.location.zip", "$.location.postalCode"],
        "locality": ["$.geo.city", "$.geo.locality", "$.location.city", "$.location.locality"],
        "municipality": ["$.geo.city", "$.geo.locality", "$.location.city", "$.location.locality"],
        "latitude": ["$.geo.latitude", "$.location.latitude"],
        "longitude": ["$.geo.longitude", "$.location.longitude"],
        "property_type": ["$.subtype", "$.type"],
        "livable_surface": ["$.surface", "$.livableSurface"],
        "land_surface": ["$.landSurface"],
        "bedrooms": ["$.bedrooms"], "bathrooms": ["$.bathrooms"], "toilets": ["$.toilets"],
        "build_year": ["$.buildYear", "$.constructionYear"],
        "facades": ["$.facades"], "number_of_floors": ["$.floors"],
        "primary_energy_consumption": ["$.energy.consumption"],
        "building_state": ["$.condition"], "kitchen_equipment": ["$.kitchen"],
        "heating_type": ["$.energy.heating"], "epc": ["$.energy.epc", "$.epc"],
        "price": ["$.price"],
        "new_construction": ["$.features.newConstruction"],
        "furnished": ["$.features.furnished"], "terrace": ["$.features.terrace"],
        "garden": ["$.features.garden"],
        "swimming_pool": ["$.features.pool", "$.features.swimmingPool"],
        "elevator": ["$.features.elevator", "$.features.lift"],
        "cellar": ["$.features.cellar", "$.features.basement"],
        "solar_panels": ["$.features.solarPanels"],
        "air_conditioning": ["$.features.airConditioning"],
        "has_parking": ["$.features.parking"],
    },
    completeness={
        "property_type": 0.95, "livable_surface": 0.9, "land_surface": 0.5, "bedrooms": 0.95,
        "bathrooms": 0.8, "toilets": 0.4, "build_year": 0.6, "facades": 0.5,
        "number_of_floors": 0.3, "primary_energy_consumption": 0.7, "epc": 0.8,
        "building_state": 0.5, "kitchen_equipment": 0.5, "heating_type": 0.5, "price": 1.0,
        "latitude": 0.9, "longitude": 0.9, "street": 0.75, "postal_code": 1.0, "terrace": 0.8,
        "garden": 0.8, "elevator": 0.7, "cellar": 0.5, "swimming_pool": 0.7, "has_parking": 0.7,
    })

MAPPINGS = {m.name: m for m in (PORTAL_ONE, PORTAL_TWO)}


def default_weights() -> dict[str, float]:
    """Source weights for duplicate ties: the sum of each source's completeness."""
    return {name: m.weight for name, m in MAPPINGS.items()}
