"""Operators for preparing training text: duplicates, tokens, quality, language, licences, mixing and shards."""
