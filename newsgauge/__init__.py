"""newsgauge: headline sentiment analytics expressed as PySpark DataFrame plans."""
