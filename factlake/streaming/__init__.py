"""Structured Streaming forms of the append-only ledger and of the state timeline.

These extend the batch operators; late rows are handled as each function says.
"""
