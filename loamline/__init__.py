"""Training-data preparation, curation and measurement as Spark plans."""
