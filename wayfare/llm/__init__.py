"""Training-data operators: deduplication, packing, filtering and formatting of text at corpus scale."""
