"""grainmill: a PySpark-native engine for preparing and analysing language-model training data."""
