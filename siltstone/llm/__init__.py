"""Operators for collecting training data. Nothing outside this subpackage imports it."""
