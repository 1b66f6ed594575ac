"""Operators for large training corpora.

Self-contained: nothing else in the library imports this subpackage.
"""
