"""Brickyard plans."""
