"""Evidence matching at scale, and training-data operators, as Spark jobs."""
