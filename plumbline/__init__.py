"""Site harmonization of long-format measurement tables on Spark DataFrames."""
