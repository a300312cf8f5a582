"""Column functions: text, URLs, citations, hashes, vectors, metrics, audit."""
