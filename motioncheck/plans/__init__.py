"""plans of the motion engine."""
