"""Column expressions: text, regex dialect, entropy, decoding, hashing."""
