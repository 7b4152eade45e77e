"""quillon: knowledge retrieval, code-graph and usage analytics as Spark DataFrames."""
