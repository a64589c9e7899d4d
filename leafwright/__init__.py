"""Analytics and cleaning of scientific and multilingual documents on Spark."""
