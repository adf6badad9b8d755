"""Surface-wear analytics expressed as Spark DataFrame plans."""
