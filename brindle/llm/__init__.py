"""Training-data operators: language, duplicates, privacy, tokens, mixing, pages, packing, quality."""
