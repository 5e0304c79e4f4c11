"""Segment, sequence and embedding analytics on PySpark DataFrames."""
