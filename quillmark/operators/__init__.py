"""DataFrame operators: ordering, profile, sampling, metrics, selection, models."""
