"""operators of the motion engine."""
