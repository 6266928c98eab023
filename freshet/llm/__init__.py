"""Operators for preparing training text at scale.

Nothing else in the library imports this package.  ``queries`` lists one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
