"""lodestar: search-performance and content-quality analytics as Spark plans."""
