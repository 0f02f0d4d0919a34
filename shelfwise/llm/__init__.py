"""Operators for preparing language-model training data. Nothing else in shelfwise imports this subpackage."""
