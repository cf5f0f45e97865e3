"""Column functions: reading JSON payloads, field rules, and reasons."""
