"""Training-data operators: packing, quality, encoding, scoring and duplicate removal."""
