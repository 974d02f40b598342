"""Two families of errors: of computation (Cxxxx) and of statistics (Sxxxx)."""


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class ComputeError(EngineError):
    """Wrong types, shapes or names of targets; unreadable input."""


class StatError(EngineError):
    """Missing columns, too few rows, singular designs, values out of a model's range."""
