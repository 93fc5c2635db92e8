"""Raster, scene and labelled-sample analytics as DataFrame transformations on Apache Spark."""

__version__ = "0.1.0"
