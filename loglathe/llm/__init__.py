"""Training-data operators: media columns, deduplication, tokenizers, quality, mixing, chat."""
