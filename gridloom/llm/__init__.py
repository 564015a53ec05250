"""Operators for preparing language-model training corpora (deletable as a whole)."""
