"""docquery: document ingest and hybrid retrieval as Spark DataFrame plans."""
