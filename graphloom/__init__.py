"""Graph, sparse-matrix and training-data processing on PySpark DataFrames."""
