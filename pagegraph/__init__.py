"""A PySpark-native engine for large bundles of page-level records."""
