"""operators of the mobility engine."""
