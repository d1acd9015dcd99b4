"""Bitemporal quads, graph patterns, Cypher, SPARQL, inference and vectors on Spark DataFrames."""
