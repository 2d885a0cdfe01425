"""A retrieval, graph-ranking and corpus-preparation engine on PySpark DataFrames."""
