"""Memory and retrieval analytics as Spark jobs."""
