"""Operators over fact logs: parsing, histories, retrieval, plans, audits."""
