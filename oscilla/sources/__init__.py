"""sources of the biosignal engine."""
