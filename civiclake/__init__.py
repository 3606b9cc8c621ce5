"""Medallion-lakehouse operators for public-service data, written on Spark DataFrames."""
