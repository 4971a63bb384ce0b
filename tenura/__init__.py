"""tenura: panel, survival and demand analytics expressed as Spark plans."""
