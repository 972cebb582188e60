"""sievework: ranked-retrieval and evidence analytics as Spark DataFrame plans."""
