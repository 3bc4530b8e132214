"""Spatial elimination, transit and POI analytics on Spark."""
