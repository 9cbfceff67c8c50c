"""plans of the mobility engine."""
