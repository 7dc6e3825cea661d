"""Operations of a training-data pipeline: fingerprints, near-duplicates, tokens, mixing, packing, archives."""
