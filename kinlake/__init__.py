"""Entity grouping over embedding vectors, on Spark."""
