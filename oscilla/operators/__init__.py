"""operators of the biosignal engine."""
