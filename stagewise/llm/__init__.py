"""Operators for preparing language-model training corpora.

Nothing else in the package imports this folder; its queries are collected in
``stagewise.llm.queries``.
"""
