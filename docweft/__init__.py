"""Document operations as Spark DataFrame operators."""
