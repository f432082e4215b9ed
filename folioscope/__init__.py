"""Measure text corpora and audit curated, versioned datasets with Spark DataFrames."""
