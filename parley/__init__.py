"""parley: conversation analytics as Spark DataFrame operators."""
