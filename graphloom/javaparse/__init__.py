"""A reader of Java sources: tokens, and a syntax tree of what the operators consume."""
