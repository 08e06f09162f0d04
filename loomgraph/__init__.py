"""Property-graph, event-log and corpus analytics expressed as Spark DataFrame plans."""
