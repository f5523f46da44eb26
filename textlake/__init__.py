"""textlake: build and query document corpora that come from tables, on Spark."""
