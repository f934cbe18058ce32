"""What the engine raises."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of the engine."""


class SyntaxProblem(EngineError):
    """A text that isn't in the language; it carries the place."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


class ValidationError(EngineError):
    """A well-formed request that the schema or the variables don't allow."""


class CollectionNotFound(ValidationError):
    """No collection has this name."""


class Unauthorized(EngineError):
    """The request needs a signed-in user."""


class Forbidden(EngineError):
    """The user lacks a role."""
