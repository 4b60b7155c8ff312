"""Organisation-quality analytics as DataFrame-to-DataFrame Spark jobs."""
