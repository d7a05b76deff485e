"""Training-data operators: quality, PII, chat trees, BPE, near duplicates, LM scoring, language, decontamination, shards, Merkle manifest,
HTML text, periodic runs."""
