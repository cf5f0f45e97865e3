"""Readers: lines of files, push envelopes, and the pipeline's own tables."""
