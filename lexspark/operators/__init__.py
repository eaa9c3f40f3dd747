"""DataFrame operators: index building, search, evaluation, codec, query log."""
