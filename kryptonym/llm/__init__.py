"""Training-data operators: scans, fingerprints, dedup, sharding, packing, scoring."""
