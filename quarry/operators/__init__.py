"""Relational operators over files, symbols, vectors, logs and sessions."""
