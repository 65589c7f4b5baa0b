"""Volumetric segmentation analytics on PySpark."""
