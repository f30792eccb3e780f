"""sources of the motion engine."""
