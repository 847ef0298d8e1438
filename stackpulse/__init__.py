"""Sensor-telemetry analytics as Spark jobs."""
