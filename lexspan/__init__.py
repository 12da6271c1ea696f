"""lexspan: a Spark-first engine for lexical-coverage analysis of language models."""
