"""A Spark-first analytics engine for multilingual news publishing."""
