"""siderea: a PySpark-native analytics engine for stacks of repeated measurements."""
