"""A Spark-native engine for verified event-funnel analytics."""
