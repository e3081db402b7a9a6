"""Operators of a training-data pipeline: filters, dedup, decontamination, PII, tokenizing, language models.

Nothing else in the library imports this package; its queries are in ``queries.py``.
"""
