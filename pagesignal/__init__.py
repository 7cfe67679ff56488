"""Spark jobs that prepare and measure web content for search and answer engines."""
