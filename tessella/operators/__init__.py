"""DataFrame operators: n-grams, metrics, candidate selection, retrieval, corpus preparation, blending, contracts."""
