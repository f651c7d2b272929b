"""DataFrame operators: analysis, index, retrieval, ranking, graph and table checks."""
