"""Level and status classes. The four classifiers differ on purpose; each serves another report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of each detected level, in the order in which levels win.
LEVEL_WORDS = {"error": ("error", "exception", "fatal"), "warn": ("warn",), "debug": ("debug",), "info": ("info",)}


def contains_ci(col: Column, text: str) -> Column:
    """Literal, case-insensitive."""
    return F.lower(col).contains(text.lower())


def _first(message: Column, order: tuple[str, ...], words, default: str) -> Column:
    out = F
    for level in order:
        hit = F.lit(False)
        for w in words(level):
            hit = hit | contains_ci(message, w)
        out = out.when(hit, level)
    return out.otherwise(default)


def detected_level(message: Column) -> Column:
    """error (or exception, fatal), warn, debug, info, else unknown."""
    return _first(message, ("error", "warn", "debug", "info"), LEVEL_WORDS.get, "unknown")


def field_level(message: Column) -> Column:
    """Level of detected-field values: error, warn, info, debug by all keywords, else info."""
    return _first(message, ("error", "warn", "info", "debug"), LEVEL_WORDS.get, "info")


def own_word_level(message: Column) -> Column:
    """Level of the volume reports: by its own name only, else other."""
    return _first(message, ("error", "warn", "debug", "info"), lambda level: (level,), "other")


def collector_level(message: Column) -> Column:
    """Level that the collector sets: case-sensitive ERROR, WARN, DEBUG, else info."""
    return F.when(message.contains("ERROR"), "error").when(message.contains("WARN"), "warn").when(message.contains("DEBUG"), "debug").otherwise("info")


def collector_app(message: Column) -> Column:
    """App that the collector guesses from words in the message."""
    has = lambda *words: F.greatest(*[message.contains(w) for w in words], F.lit(False))
    return F.when(has("Worker", "job ID"), "worker").when(has("Cache", "cache"), "cache").otherwise("api-server")


def status_class(status: Column) -> Column:
    return F.when(status >= 500, "5xx").when(status >= 400, "4xx").when(status >= 300, "3xx").when(status >= 200, "2xx").otherwise("other")


def alb_level(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").when(status.isNotNull(), "info").otherwise("unknown")
