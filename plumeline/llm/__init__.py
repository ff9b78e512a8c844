"""Operators for preparing training corpora.

Documents are rows with ``doc_id`` and ``text`` (other columns pass by).  Each operator keeps its own interface; the
queries of this subpackage are in ``queries.py``.  Nothing outside imports this subpackage.
"""
