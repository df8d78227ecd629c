"""Panel forecasting on Spark: DataFrames in, DataFrames out."""
