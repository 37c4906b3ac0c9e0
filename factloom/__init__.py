"""factloom: a Spark-native engine for finding, explaining and repairing wrong facts in knowledge graphs."""
