"""Spark jobs that analyse HTTP traffic from many captures at once."""
