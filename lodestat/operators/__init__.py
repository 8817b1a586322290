"""lodestat."""
