"""Brickyard streaming."""
