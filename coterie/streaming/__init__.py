"""Streaming forms of the ledger operators."""
