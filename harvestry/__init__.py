"""Collection analytics, record normalisation and listing search as Spark DataFrames."""
