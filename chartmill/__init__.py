"""Analytics of chart event sequences on Spark."""
