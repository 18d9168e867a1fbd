"""cohortloom: cohort, interval, quality and feature analytics as plain functions over Spark DataFrames."""
