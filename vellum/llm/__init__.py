"""Operators of a training-data pipeline: language ID, quality rules, license
scans, tokenisation, source mixing, exact search, chat formatting, language
model scoring, binary token output and near-duplicate detection.

Nothing else in the library imports this subpackage.
"""
