"""functions of the motion engine."""
