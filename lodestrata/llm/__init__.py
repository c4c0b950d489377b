"""Operators for text, code and entity data; nothing else in the library imports this package."""
