"""Part of mnesis; see the README."""
