"""DataFrame operators of the audit and of retrieval."""
