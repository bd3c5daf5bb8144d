"""Part of riskloom."""
