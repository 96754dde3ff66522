"""A PySpark-native search and analytics engine over a media catalogue."""
