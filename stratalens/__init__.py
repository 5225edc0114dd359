"""Source-structure and corpus analytics expressed as Spark DataFrame plans."""
