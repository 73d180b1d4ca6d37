"""A Spark-native engine for gas plume analytics."""
