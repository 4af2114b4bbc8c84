"""Operators for preparing language-model training data.

Nothing else in the library imports this package; the package imports only the
library's general session helpers.
"""
