"""corpusloom: document analytics as Spark DataFrame plans."""
