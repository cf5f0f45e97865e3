"""Whole jobs: loading files, reports, schema export."""
