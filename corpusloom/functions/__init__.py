"""Column functions: text, vectors, citations, access control and routing."""
