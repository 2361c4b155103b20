"""proseflow: a PySpark-native engine for long-running series of policy texts."""
