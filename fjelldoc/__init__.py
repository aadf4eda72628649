"""Document and map analytics as lazy PySpark DataFrame operators."""
