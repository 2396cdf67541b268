"""skein: a Spark-native engine for property graphs, code indexes, event memory and text retrieval."""
