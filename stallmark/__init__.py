"""stallmark: marketplace-evidence analytics expressed as Spark DataFrame plans."""
