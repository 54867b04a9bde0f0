"""Refusals: typed errors that stand for results which must not be guessed."""


class Refused(ValueError):
    """Base of all refusals; ``code`` names the kind."""

    code = "invalid_argument"


class EmptyFilter(Refused):
    code = "empty_filter"


class MissingScope(Refused):
    code = "missing_scope"


class EmptyQuery(Refused):
    code = "empty_query"


class ShortQuery(Refused):
    code = "short_query"


class BudgetExceeded(Refused):
    code = "budget_exceeded"


class NothingCitable(Refused):
    code = "validation_failed"


class ModelConflict(Refused):
    code = "model_conflict"


class NotFound(Refused):
    code = "not_found"
