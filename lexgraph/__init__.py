"""A PySpark-native analytics engine for hierarchical, versioned document corpora."""
