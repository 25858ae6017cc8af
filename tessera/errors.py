"""The engine's errors, one class for each family; ``code`` tells them apart."""

from __future__ import annotations

from contextlib import contextmanager


class EngineError(Exception):
    """Base of all errors; ``code`` is a short stable name."""

    code = "engine"

    def __init__(self, message: str = "", code: str | None = None) -> None:
        super().__init__(message or self.__doc__)
        if code:
            self.code = code


class DriveError(EngineError):
    """A path can't be read, written, created or locked."""

    code = "drive"


class DepthError(EngineError):
    """Brackets or values are nested too deeply."""

    code = "depth"


class InterruptError(EngineError):
    """The work was cancelled."""

    code = "interrupt"


class ShapeError(EngineError):
    """Lengths don't conform, or a rank or an index is out of range."""

    code = "shape"


class CallError(EngineError):
    """A wrong number or kind of arguments."""

    code = "call"


class KindError(EngineError):
    """A value of a wrong kind: text, list, map, table, key, column, row or ragged list."""

    code = "kind"


class LexError(EngineError):
    """The text holds something that is no token."""

    code = "lex"


class ParseError(EngineError):
    """The tokens form no statement."""

    code = "parse"


class BracketError(ParseError):
    """Brackets that don't match."""

    code = "bracket"


class NestedClauseError(ParseError):
    """A clause inside another one without brackets."""

    code = "nested"


class InsertValuesError(ParseError):
    """Rows to insert that don't fit the table."""

    code = "values"


class NetworkError(EngineError):
    """A remote end failed."""

    code = "network"


class LibraryError(EngineError):
    """A user function can't be loaded."""

    code = "library"


class ParallelError(EngineError):
    """A parallel job failed."""

    code = "parallel"


class TimeError(EngineError):
    """A stamp or span out of range, or units that don't mix."""

    code = "time"


class JsonKeyError(EngineError):
    """A key that JSON can't hold."""

    code = "json"


class FormatError(EngineError):
    """A bad radix or format."""

    code = "format"


class CompressionError(EngineError):
    """Data that can't be packed or unpacked."""

    code = "compression"


class CappedError(EngineError):
    """A value beyond the cap of a container."""

    code = "capped"


@contextmanager
def wrapped():
    """Spark's own errors as this engine's, by what they are about."""
    from pyspark.errors import AnalysisException, PySparkException

    try:
        yield
    except AnalysisException as e:
        what = e.getCondition() or ""
        raise (DriveError if "PATH" in what else KindError)(str(e).split("\n")[0], what) from e
    except PySparkException as e:
        what = e.getCondition() or ""
        raise (ShapeError if "does not conform" in str(e) or "INDEX" in what else EngineError)(str(e).split("\n")[0], what) from e
