"""docweave: hybrid retrieval, text rules and corpus analytics written as Spark plans."""
