"""Part of quaystat."""
