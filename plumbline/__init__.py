"""plumbline: evaluation, curation and audit of structured records on Spark DataFrames."""
