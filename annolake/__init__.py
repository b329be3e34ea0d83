"""annolake: a PySpark-native engine for span-annotated document collections."""
