"""Operators for preparing language-model training corpora.

Self-contained: nothing outside this subpackage imports it.
"""
