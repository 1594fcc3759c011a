"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it. ``heddle.llm.catalog`` holds the
registered queries and their SQL counterparts.
"""
