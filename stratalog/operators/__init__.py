"""Relational operators over logs and snapshots."""
