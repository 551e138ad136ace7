"""A Spark-native engine for fuzzy title search, entity resolution and ranking evaluation."""
