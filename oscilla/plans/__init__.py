"""plans of the biosignal engine."""
