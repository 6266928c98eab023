"""Forecast plans: folds, selection, features, post-processing, scores, tables."""
