"""The library's errors."""


class FramepackError(Exception):
    """Base of all errors."""


class ParseError(FramepackError):
    """A document that does not follow the grammar."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None, token: str | None = None):
        super().__init__(message + (f" at line {line}, column {column}" if line is not None else ""))
        self.line, self.column, self.token = line, column, token


class TypeMismatchError(FramepackError):
    """A value that its declared type cannot hold."""

    def __init__(self, message: str, expected: str | None = None, actual: str | None = None):
        super().__init__(message)
        self.expected, self.actual = expected, actual


class SchemaError(FramepackError):
    """A schema that cannot be registered or resolved."""


class ValidationError(FramepackError):
    """Rows that break their schema."""

    def __init__(self, message: str, errors: list | None = None):
        super().__init__(message)
        self.errors = errors or []


class XmlParseError(ParseError):
    """XML that is not well-formed."""


class XmlConversionError(FramepackError):
    """An object that stands for no XML element."""


class XmlStructureError(FramepackError):
    """An XML tree that breaks a rule of structure."""
