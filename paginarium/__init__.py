"""Document analytics expressed as Spark DataFrame plans."""
