"""Operators for corpora and corpus-scale statistics; nothing outside this subpackage imports it."""
