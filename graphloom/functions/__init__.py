"""Column functions: row-wise classification, packing, hashing, naming."""
