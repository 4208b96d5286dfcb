"""Training-data operators (packing, scans, dedup, tokenisation). Nothing else in tessera imports this subpackage."""
