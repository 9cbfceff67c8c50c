"""functions of the mobility engine."""
