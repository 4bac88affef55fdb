"""Training-data operators: tokens, packing, fingerprints, filters and near-duplicates."""
