"""Brickyard: property-market analytics as PySpark jobs on tables of listings."""
