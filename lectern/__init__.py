"""Lectern: learning-management-system reports as Spark DataFrame programs."""
