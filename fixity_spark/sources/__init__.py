"""Readers and writers of trees, listings, manifests, location files, counters, sidecars and reports."""
