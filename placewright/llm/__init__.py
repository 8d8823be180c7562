"""Operators on text corpora and listings; nothing outside this subpackage imports it."""
