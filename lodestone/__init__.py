"""Lodestone: document collections, secondary indexes, text, spatial, vector and versioned reads on Spark DataFrames."""
