"""Permission-aware retrieval, evaluation and corpus processing on Spark DataFrames."""
