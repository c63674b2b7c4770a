"""Readers and writers: every one is a Spark scan or a Spark write."""
