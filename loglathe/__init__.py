"""Analytics over conversation logs on Spark."""
