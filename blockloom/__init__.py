"""Raster-block analytics on PySpark: tiling, reordering, block transforms, aggregates and lossless codecs."""
