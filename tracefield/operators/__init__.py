"""Operators on trips, rasters and road graphs. Request tables in, result tables out."""
