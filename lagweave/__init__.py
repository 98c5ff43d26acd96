"""Point-in-time feature engine and training-data operators on PySpark DataFrames."""
