"""Evidence-grounded document analytics as Spark DataFrame operators."""
