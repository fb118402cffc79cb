"""Planning which operators a question needs."""
