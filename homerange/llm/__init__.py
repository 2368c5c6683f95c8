"""Training-data operators: language, toxicity, quality, near and exact
duplicates, extraction, tokenizing and packing. Nothing else in the library
imports this subpackage."""
