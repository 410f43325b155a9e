"""Column expressions over texts, paths and Markdown."""
