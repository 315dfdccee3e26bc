"""Part of wirelake."""
