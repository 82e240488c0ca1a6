"""Brickyard operators."""
