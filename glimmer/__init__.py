"""Search and indexing of large media libraries on Spark."""
