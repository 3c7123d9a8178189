"""Corpus operators for large training sets; nothing else in the package imports this."""
