"""Operators for preparing text corpora: scans, fingerprints, filters, packing."""
