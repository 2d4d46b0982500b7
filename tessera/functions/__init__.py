"""Scalar functions of the dialect on Spark expressions."""
