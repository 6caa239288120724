"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it is discovered by
``__spark_entry__`` when it is present.
"""
