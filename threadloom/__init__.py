"""threadloom: Spark-native analysis of technical discourse."""
