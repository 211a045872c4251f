"""Operators over DataFrames: interval and allele joins, islands, maps and windows, linkage disequilibrium, simulation."""
