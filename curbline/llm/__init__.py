"""Training-data operators for very large text, page and vector tables.

Nothing else in the library imports this subpackage.  Every operator keeps its own general
interface; the thin queries with contract columns live in :mod:`curbline.llm.queries`.
"""
