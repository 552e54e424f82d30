"""Errors the engine raises while it reads or compiles an expression."""


class DaxError(Exception):
    """Base of all errors of the engine."""


class DaxSyntaxError(DaxError):
    """The text is no expression."""


class UnknownName(DaxError):
    """A table, column, measure, variable or function that the model doesn't have."""


class UnsupportedFunction(DaxError):
    """A catalog function that needs something this engine has no notion of."""
