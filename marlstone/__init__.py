"""Knowledge store, retrieval, graph and text operators as Spark DataFrames."""
