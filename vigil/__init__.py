"""Security-telemetry analytics and corpus operators on PySpark."""
