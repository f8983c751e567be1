"""Training-data operators: packing, scoring, deduplication, filtering, archives and token files."""
