"""Operators for preparing large training corpora, each in a module of its own; `queries` registers them."""
