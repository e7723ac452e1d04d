"""A PySpark-native engine for dataset manifests and analytics."""
