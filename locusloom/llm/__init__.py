"""Training-data operators: quality, contamination, packing, rules, private data, shards, language models, secrets, joins, token counts."""
