"""A PySpark engine for visual-anomaly analytics."""
