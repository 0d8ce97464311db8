"""Models, their dependencies and their build loop."""
