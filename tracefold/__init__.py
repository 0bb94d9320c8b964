"""Evidence-graph analytics as Spark DataFrame operators."""
