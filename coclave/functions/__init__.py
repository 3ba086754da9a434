"""Part of coclave; see README.md."""
