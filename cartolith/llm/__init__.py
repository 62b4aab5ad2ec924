"""Training-data operators: extraction, filters, deduplication, packing, formatting."""
