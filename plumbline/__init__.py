"""plumbline: a Spark-native engine for laser-scan and building-model analytics."""
