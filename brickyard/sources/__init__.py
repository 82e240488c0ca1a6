"""Brickyard sources."""
