"""Table schemas and errors."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField

#: One row for each recorded change.  ``seq`` orders changes of one tick.
WAVE = T.StructType([
    _f("timestamp", T.LongType(), False), _f("seq", T.LongType(), False), _f("signal_id", T.LongType(), False), _f("value_raw", T.StringType(), False),
    _f("value_kind", T.ByteType(), False), _f("value_scalar", T.ShortType()), _f("value_real", T.DoubleType()),
])

#: One row for each declared name; several names may share an id.
SIGNALS = T.StructType([
    _f("signal_id", T.LongType(), False), _f("signal_name", T.StringType(), False), _f("var_type", T.StringType()), _f("size", T.IntegerType()), _f("id_code", T.StringType()),
    _f("range", T.StringType()), _f("scope", T.StringType()), _f("reference", T.StringType()), _f("handle", T.LongType()), _f("direction", T.StringType()), _f("is_alias", T.BooleanType()),
])

#: One row for each trace.
TRACE_INFO = T.StructType([
    _f("source", T.StringType(), False), _f("version", T.StringType()), _f("date", T.StringType()), _f("timescale_raw", T.StringType()), _f("timescale_seconds", T.DoubleType()), _f("timescale_exponent", T.IntegerType()),
    _f("start_time", T.LongType()), _f("end_time", T.LongType()), _f("var_count", T.LongType()), _f("max_handle", T.LongType()), _f("path", T.StringType()), _f("fingerprint", T.StringType()),
])


class TraceError(Exception):
    """Base of all errors of this package."""


class NotLoadedError(TraceError):
    """A query needs a trace and none is loaded."""


class InvalidRangeError(TraceError, ValueError):
    """A time or cycle range is missing or inverted."""


class SignalNotFoundError(TraceError, LookupError):
    """No signal, or no clock cycle, goes by that name."""


class LoadError(TraceError):
    """A file can't be read as a trace."""
