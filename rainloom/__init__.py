"""rainloom: station-series analytics as declarative Spark plans."""
