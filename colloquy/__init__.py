"""Prepare, check and score post-training conversations as Spark jobs."""

__version__ = "0.1.0"
