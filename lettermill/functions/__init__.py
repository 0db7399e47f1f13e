"""Column functions: defaults, text, rules, replies of models."""
