"""Operators for preparing training corpora: filtering, near-duplicates, sanitising, packing, encodings, archives, search."""
