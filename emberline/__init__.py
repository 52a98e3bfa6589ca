"""Temporal contact-network risk engine on Spark DataFrames."""
