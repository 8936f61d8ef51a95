"""quaystat: statistical open-data pipelines and semantic queries as Spark DataFrame plans."""
