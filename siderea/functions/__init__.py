"""Part of siderea."""
