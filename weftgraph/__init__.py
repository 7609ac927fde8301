"""weftgraph: concept-graph analytics expressed as Spark DataFrame plans."""
