"""Signal analytics on Spark: tables of signals in, tables of results out."""
