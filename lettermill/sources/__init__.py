"""Where messages come from, and where they go."""
