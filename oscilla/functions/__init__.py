"""functions of the biosignal engine."""
