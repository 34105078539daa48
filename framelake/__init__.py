"""Analytics over media bitstream records as Spark tables."""
