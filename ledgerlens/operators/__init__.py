"""Relational operators over a payment ledger."""
