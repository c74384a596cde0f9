"""Column builders: URLs, text, Markdown clean-up, scalars."""
