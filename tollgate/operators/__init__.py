"""DataFrame operators: verdicts, ledger, deduplication, quarantine, counts and the generator."""
