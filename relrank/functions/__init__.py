"""Column expressions: hashing, text templates, logits."""
