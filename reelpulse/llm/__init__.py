"""Training-data operators: cleaning, deduplication, scoring, packing and archiving of text corpora."""
