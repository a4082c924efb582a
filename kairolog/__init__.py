"""Bi-temporal Datalog over Spark DataFrames."""
