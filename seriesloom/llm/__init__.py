"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  `queries` holds the registered
queries and their SQL; each operator lives in a module of its own.
"""
