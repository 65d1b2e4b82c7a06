"""Document retrieval and evaluation as Spark plans."""
