"""Operators on the texts of an archive for language-model training data. Nothing outside this subpackage imports it."""
