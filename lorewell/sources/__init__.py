"""Readers and writers: note directories, NDJSON shards, event logs, derived stores, and bound test tables."""
