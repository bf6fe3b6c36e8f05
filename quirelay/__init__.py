"""Document-layout and text analytics on Spark."""
