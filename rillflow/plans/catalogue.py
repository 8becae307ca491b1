"""Which datasets a run covers: the catalogue, selections and their text form, typed settings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dataset keys by tab, in order; those not taken unless asked for; those added to the catalogue last.
TABS = {
    "bassin": ("metriques", "affinage"),
    "sol": ("corine", "bati", "foret", "carhab"),
    "agricole": ("rpg", "bio", "prairies", "aoc", "haies", "onf"),
    "zonages": ("znieff1", "znieff2", "zsc", "zps", "apb", "rnn", "rnr", "pnr", "ramsar", "zhumide", "cen", "compens", "autres", "zhim", "gbif"),
    "eau": ("masse_eau", "meso", "her", "sage", "roe", "hydrometrie", "vigicrues", "prelevements", "steu", "population", "basias", "basol", "sis", "irep"),
}
OPTIONAL = frozenset({"affinage", "carhab"})

KEYS = tuple(key for keys in TABS.values() for key in keys)
DEFAULTS = frozenset(KEYS) - OPTIONAL


def selection(keys: Iterable[str] | None) -> frozenset[str]:
    """The known ones of some keys; the defaults where nothing is said."""
    return DEFAULTS if keys is None else frozenset(map(str, keys)) & frozenset(KEYS)


def as_text(keys: Iterable[str] | None) -> str:
    """A selection in catalogue order, comma-joined."""
    held = selection(keys)
    return ",".join(k for k in KEYS if k in held)


def from_text(text: str | None, known: str | None = None, later: Iterable[str] = ()) -> frozenset[str]:
    """A selection back from its text; an empty text selects nothing, none at all the defaults.

    Datasets that the catalogue lacked when the text was made (those not in ``known``, or ``later`` where that was
    not kept) could not be deselected, so they are in if they are in by default.
    """
    if text is None:
        return DEFAULTS
    unseen = frozenset(later) if known is None else frozenset(KEYS) - frozenset(known.split(","))
    return selection(text.split(",")) | DEFAULTS & unseen


def ordinal(key: Column) -> Column:
    """Place of a dataset in the catalogue, from 1, to restore its order after parallel work; null for unknown keys."""
    return F.nullif(F.array_position(F.array(*map(F.lit, KEYS)), key), F.lit(0)).cast("int")


def tab_of(key: str) -> str:
    return next(tab for tab, keys in TABS.items() if key in keys)


def setting(stored: Mapping[str, object], key: str, default):
    """A stored setting in the type of its default, or the default where it is missing or cannot be read."""
    value = stored.get(key)
    if value is None:
        return default
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes")
    try:
        return type(default)(value)
    except (TypeError, ValueError):
        return default
