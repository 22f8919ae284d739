"""Scalar and text functions as Spark columns."""
