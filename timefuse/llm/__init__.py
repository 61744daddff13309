"""Operators of a large-scale training-data pipeline (documents, pages, conversations).

Nothing else in the library imports this subpackage; its queries are
registered by ``timefuse.llm.queries``.
"""
