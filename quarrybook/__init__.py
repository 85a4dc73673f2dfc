"""Document-grounded retrieval, curation and evaluation as Spark DataFrame operators."""
