"""Filing and research analytics expressed as Spark DataFrame operators."""
