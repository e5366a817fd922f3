"""Operators for building training corpora. Outside this folder only graphs import it, for components."""
