"""What a request can be refused with."""


class EngineError(ValueError):
    """Base of all refusals."""


class UnsupportedParam(EngineError):
    """A parameter, modifier or literal that cannot be evaluated; nothing is guessed."""


class NotFound(EngineError):
    """No such resource or version."""


class Gone(EngineError):
    """The resource was deleted."""


class Conflict(EngineError):
    """Another version than expected, or several matches where one may be."""


class TooLarge(EngineError):
    """More rows than a guard allows."""


class Invalid(EngineError):
    """A body that fails validation or a patch that cannot be applied."""
