"""Operators for large training-data pipelines.

``queries.py`` registers one query per operator; ``corpus_pipeline.py`` at the
repository top chains five of them. Nothing else in the library imports this
subpackage.
"""
