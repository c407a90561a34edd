"""Operators over announcement snapshots: scan control, diff, enrichment, manifests."""
