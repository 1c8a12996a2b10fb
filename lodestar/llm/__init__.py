"""Operators of a training-data pipeline: token counts, quality, mixing,
sharding, byte-level BPE, line dedup, embedding near-dedup, media columns, chat
formatting, MinHash near-dedup, document fingerprints, importance resampling and
lexical search. Nothing else in the library imports this subpackage."""
