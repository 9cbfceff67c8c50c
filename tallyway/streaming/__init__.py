"""streaming of the mobility engine."""
