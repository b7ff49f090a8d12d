"""DataFrame operators: features, neighbours, statistics, serving, quality."""
