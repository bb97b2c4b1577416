"""Keyed event-time dataflows on Spark DataFrames."""
