"""adjudica: public-tender analytics expressed as Spark DataFrame plans."""
