"""DataFrame operators over traces, steps and step-usage tables."""
