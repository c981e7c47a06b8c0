"""Property-graph analytics for software, expressed as Spark plans."""
