"""Queries over cluster objects, events and container logs as Spark jobs."""
