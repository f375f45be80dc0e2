"""Program and advisor analytics as Spark DataFrame operators."""
