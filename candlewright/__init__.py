"""Market-data candles on Spark."""
