"""The closed set of errors of the dialect."""


class DialectError(Exception):
    """Any statement that the dialect rejects."""


class SyntaxFault(DialectError):
    pass


class NoSuchTable(DialectError):
    pass


class NoSuchColumn(DialectError):
    pass


class AmbiguousColumn(DialectError):
    pass


class ColumnCountMismatch(DialectError):
    pass


class UnknownFunction(DialectError):
    pass


class WrongArgumentCount(DialectError):
    pass


class DatatypeMismatch(DialectError):
    pass


class ConstraintFault(DialectError):
    pass


class InvalidEscape(DialectError):
    pass


class Unsupported(DialectError):
    pass
