"""Operators for preparing language-model training data.

Self-contained: nothing else in the package imports this subpackage.
"""
