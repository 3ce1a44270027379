"""Corpus operators for language-model data; nothing outside this subpackage imports it."""
