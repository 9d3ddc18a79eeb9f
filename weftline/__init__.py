"""Declared data changes, their proof, and change-history analytics on Spark DataFrames."""
