"""Dataset operators for literature retrieval, as Spark plans."""
