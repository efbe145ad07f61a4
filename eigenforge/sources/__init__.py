"""Count matrices from tables."""
