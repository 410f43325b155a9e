"""Index maintenance driven by streams of changed files."""
