"""Analytics over code-quality evidence, expressed as Spark plans."""
