"""Training-data operators: WARC, packing, deduplication, PII, language ID, ANN, mixing, decontamination."""
