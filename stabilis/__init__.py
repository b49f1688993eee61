"""Response-similarity and stability analytics expressed as Spark DataFrame jobs."""
