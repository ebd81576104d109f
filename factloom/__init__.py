"""factloom: a Spark-native engine for evidence-anchored facts and how they relate."""
