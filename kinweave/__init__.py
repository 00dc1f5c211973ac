"""kinweave: observations to entities, as Spark DataFrame plans."""
