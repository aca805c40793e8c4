"""Relational operators: vocabulary, phrases, scores, labels, splits, models, thresholds."""
