"""Operators on frame, interval, map and pooled tables; every one takes and returns DataFrames."""
