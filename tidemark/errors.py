"""Errors that a request can raise before anything runs."""


class RequestError(ValueError):
    """The request is not valid for the resource it names."""


class SyntaxFault(RequestError):
    """The query text does not follow the grammar."""
