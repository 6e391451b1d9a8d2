"""granary: a Spark-native engine for dataset integrity, splitting and detection evaluation."""
