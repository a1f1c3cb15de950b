"""Column-level building blocks: text, labels, pages and model-answer parsing."""
