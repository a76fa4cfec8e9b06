"""Operations of a training-data pipeline: tokens, fingerprints, duplicates, quality, WARC and packing."""
