"""mnesis: a Spark-native analytics engine for long-term agent memory and for text corpora."""
