"""A PySpark-native engine for building instruction-tuning datasets for code models."""
