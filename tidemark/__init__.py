"""Batch change-data replication as Spark jobs."""
