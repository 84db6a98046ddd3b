"""veilframe: span detection, pseudonymisation and corpus preparation on Spark DataFrames."""
