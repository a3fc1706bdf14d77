"""Brightloom: relational, statistical and text analytics declared on Spark DataFrames."""
