"""Column expressions: canonical text, hashes, tokens, chunks, vectors."""
