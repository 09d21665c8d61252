"""folioflow: page-and-text-region processing expressed as Spark DataFrames."""
