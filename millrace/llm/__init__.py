"""Operators for text that large models are trained on. Nothing else in the library imports this subpackage."""
