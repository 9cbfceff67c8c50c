"""sources of the mobility engine."""
