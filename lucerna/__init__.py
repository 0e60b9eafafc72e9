"""lucerna: a PySpark-native engine that classifies, condenses and keeps retrievable large collections of text."""
