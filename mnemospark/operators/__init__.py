"""DataFrame operators: retrieval, vectors, events, sessions, quality, maintenance."""
