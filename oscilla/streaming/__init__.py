"""streaming of the biosignal engine."""
