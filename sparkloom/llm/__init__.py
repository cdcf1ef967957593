"""Training-data operators: deduplication, fingerprints, filters, classifiers and mixing at corpus scale."""
