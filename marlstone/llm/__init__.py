"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` registers its
``opN_<name>`` queries and the ``pipeline`` query.
"""
