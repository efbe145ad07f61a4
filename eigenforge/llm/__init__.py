"""Operators for preparing large text corpora: tokens, mixing, deduplication, quality, chat, WARC."""
