"""Operators on language: names, typed values and texts. Nothing outside this subpackage imports it."""
