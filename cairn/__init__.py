"""cairn: a Spark-native code index and text-corpus engine."""
