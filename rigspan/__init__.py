"""Robot-demonstration data engine on Spark: logs, episodes, samples, metrics."""
