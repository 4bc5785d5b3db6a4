"""Part of sheaf."""
