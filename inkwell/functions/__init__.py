"""Column expressions over text, numbers and prompts."""
