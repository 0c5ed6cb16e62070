"""Errors the engine raises."""


class EngineError(Exception):
    """A command that can't be carried out."""


class FilterSyntaxError(EngineError):
    """A filter that doesn't parse; position is the character where it goes wrong."""

    def __init__(self, message: str, position: int) -> None:
        super().__init__(f"{message} (at {position})")
        self.position = position


class ColumnNotFound(EngineError):
    def __init__(self, name: str) -> None:
        super().__init__(f"Could not find column '{name}' from table schema.")
        self.name = name
