"""A Spark-native engine for hybrid (lexical and dense) search over message-like text."""
