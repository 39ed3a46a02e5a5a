"""functions of the graph and source-text engine."""
