"""siltstone: document-retrieval and training-data analytics expressed as Spark plans."""
