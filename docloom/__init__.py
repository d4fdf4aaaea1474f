"""docloom: document analytics, hybrid retrieval and corpus curation on Spark DataFrames."""
