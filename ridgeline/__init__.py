"""Sensor-series scoring and highlight analytics on Spark."""
