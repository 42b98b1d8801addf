"""A PySpark-native engine for versioned key-value data and the tables around it."""
