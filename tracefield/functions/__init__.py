"""Column functions: geometry and score vectors."""
