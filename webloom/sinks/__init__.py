"""Sinks: host chunk files, the answer store, the passage index."""
