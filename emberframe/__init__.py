"""emberframe: a PySpark-native engine for incident, perimeter and corpus data."""
