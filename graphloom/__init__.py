"""Graph analytics over source code and similar dependency data, as functions from DataFrames to DataFrames."""
