"""kinlink: record matching, ranking and evaluation as Spark DataFrame plans."""
