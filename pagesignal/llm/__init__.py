"""Operators for preparing language-model training text.

Self-contained: nothing outside this folder imports it, and it imports nothing
from the rest of the library.
"""
