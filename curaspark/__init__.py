"""Event-cluster curation analytics as PySpark DataFrame programs."""
