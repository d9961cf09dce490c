"""Training-data operators: mixing, token counts, personal data, decontamination,
sharding, top-k search, near-duplicates, tool calls, LM scoring, quality, tokenizer
alignment, prefix tries, token files.

Nothing else in the library imports this subpackage."""
