"""Driving-scenario criticality analytics as Spark DataFrame jobs."""
