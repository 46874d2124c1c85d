"""Road-sensor analytics on Spark: ingest, clean, score, report and decide with DataFrames."""
