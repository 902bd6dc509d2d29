"""Market-bar analytics as Spark DataFrame operators."""
