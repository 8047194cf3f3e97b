"""Relational and sequential operators over DataFrames."""
