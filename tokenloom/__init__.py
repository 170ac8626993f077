"""Subword tokenization over large corpora, expressed as Spark DataFrame operators."""
