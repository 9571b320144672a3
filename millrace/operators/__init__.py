"""Joins, aggregations, ranking, set and graph operators over DataFrames."""
