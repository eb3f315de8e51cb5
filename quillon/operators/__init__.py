"""DataFrame operators: nearest neighbours, vectorization, metrics, corpus processing."""
