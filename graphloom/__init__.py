"""Knowledge-graph, literature and corpus analytics expressed as Spark DataFrame operators."""
