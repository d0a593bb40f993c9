"""Column functions with the engine's semantics."""
