"""docflow: document-corpus analytics on Spark DataFrames."""
