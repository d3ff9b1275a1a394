"""Training-data operators: near-duplicate removal, chat formatting, quality and toxicity
scoring, repeated-passage removal, vector search, sharding, secret scans, packing and
SentencePiece coding. Nothing outside this subpackage imports it."""
