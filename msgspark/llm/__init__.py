"""Operators for building training corpora: cleaning, de-duplication, mixing, tokenising, searching."""
