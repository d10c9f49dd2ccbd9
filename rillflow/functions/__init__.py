"""Column expressions and record codecs."""
