"""Document preparation, retrieval and reporting as Spark DataFrame operators."""
