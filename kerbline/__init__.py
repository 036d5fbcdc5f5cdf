"""Road- and event-risk analytics as PySpark DataFrame operators."""
