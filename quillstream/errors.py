"""What conversions raise. In tables an error is data: a row's ``error`` has the message."""

from __future__ import annotations


class QuillstreamError(Exception):
    """Any error of this package."""


class NoRouteError(QuillstreamError):
    """No converter leads from one format to another."""


class SourceError(QuillstreamError):
    """A source that is missing or can't be read."""


class SinkError(QuillstreamError):
    """A target that can't be written."""


class ConfigError(QuillstreamError):
    """A configuration file that isn't a mapping."""
