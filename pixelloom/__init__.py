"""Raster analytics on Spark: images, layers and palettes as DataFrames."""
