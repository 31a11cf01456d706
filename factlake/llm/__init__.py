"""Training-data operators (deduplication, tokenising, scoring, packing, archives).

Nothing outside this subpackage imports it; see ``factlake.llm.registry``.
"""
