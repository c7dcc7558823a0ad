"""Swaralens: Spark-first analytics for speech transcripts and text corpora."""
