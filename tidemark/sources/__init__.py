"""Readers of landed pages, API payloads and snapshots."""
