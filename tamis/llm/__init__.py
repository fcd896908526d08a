"""Training-data operators for text corpora: tokens, packing, duplicates, secrets, quality, archives, exact code search."""
