"""Signal, timeline and track-table analytics as ordinary Spark DataFrame jobs."""
