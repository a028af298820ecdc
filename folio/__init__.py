"""folio: retrieval, citation analytics and training-data operators as Spark DataFrame plans."""
