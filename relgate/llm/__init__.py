"""Operators for preparing training text and embeddings; nothing outside imports them."""
