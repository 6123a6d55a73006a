"""Operators that prepare text corpora for language-model training, their queries and SQL twins."""
