"""Part of the tarnmill engine; see README.md."""
