"""Interval, sequence, retrieval, evaluation and edit operators."""
