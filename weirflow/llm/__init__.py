"""Operators for preparing text and vector corpora at scale.

Nothing outside this folder imports it.  Each module has one operator with a
general interface; :mod:`weirflow.llm.queries` holds the thin queries built on
top of them.
"""
