"""Training-data operators: deduplication, filtering, decontamination, tokenizing and formatting at corpus scale."""
