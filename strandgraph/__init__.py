"""Property-graph analytics on Spark."""
