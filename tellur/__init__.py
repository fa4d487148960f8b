"""Terrain analytics on Spark."""
