"""Campaign and traffic analytics as Spark DataFrame operators."""
