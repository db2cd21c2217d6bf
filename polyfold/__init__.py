"""Polyfold: a multi-modal analytics engine on Spark. Operators are functions from DataFrames to DataFrames."""
