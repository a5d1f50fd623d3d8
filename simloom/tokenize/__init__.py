"""Tokenisers: from a file's text to typed tokens with positions."""
