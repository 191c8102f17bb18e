"""Operators of corpora for language models. Nothing else in the library imports this subpackage."""
