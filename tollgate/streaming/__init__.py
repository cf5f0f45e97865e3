"""Structured Streaming: publishing, ingestion with the ledger, dead letters and redrive."""
