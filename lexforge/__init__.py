"""lexforge: a Spark-native engine for lemma-structured text corpora."""
