"""Card-transaction risk analytics expressed as Spark DataFrame plans."""
