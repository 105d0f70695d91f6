"""A PySpark-native analytics engine for entity-tracking news pipelines."""
