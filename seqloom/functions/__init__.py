"""Column functions and host-side helpers over letters, words and counts."""
