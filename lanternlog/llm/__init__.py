"""Training-data operators: deduplication, filtering, packing and archive writing. Nothing else in the library imports this."""
