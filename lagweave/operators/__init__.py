"""Relational operators: preprocessing, encoding, validation, windows, evaluation, selection."""
