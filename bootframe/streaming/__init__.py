"""Structured Streaming pieces (file-arrival merge of result files)."""
