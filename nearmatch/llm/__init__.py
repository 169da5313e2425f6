"""Training-data operators: packing, deduplication, mixing, scoring, extraction and scans."""
