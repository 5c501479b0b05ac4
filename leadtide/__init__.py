"""Lead-scoring features and models on PySpark DataFrames."""
