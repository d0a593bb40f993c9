class EngineError(Exception):
    """A statement that can't be run: syntax, names, types, constraints, transactions."""
