"""A PySpark-native engine that builds and queries a bank of questions mined from text."""
