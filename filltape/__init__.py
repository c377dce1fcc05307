"""Exchange-fill analytics as Spark DataFrame operators."""
