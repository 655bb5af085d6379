"""Text predicates: which tokens a query text matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.errors import UnsupportedFeature

EXACT, PREFIX, SUFFIX, SUBSTRING = "exact", "prefix", "suffix", "substring"
MODES = (EXACT, PREFIX, SUFFIX, SUBSTRING)
#: Where a mode is not offered, the next one of its row that is.
FALLBACKS = {SUBSTRING: (PREFIX, SUFFIX, EXACT), PREFIX: (EXACT,), SUFFIX: (EXACT,), EXACT: ()}


def offered_mode(mode: str, supported: frozenset[str] = frozenset(MODES)) -> str | None:
    """The mode that answers for `mode`, or None."""
    if mode not in FALLBACKS:
        raise UnsupportedFeature(f"match mode {mode}")
    return next((m for m in (mode, *FALLBACKS[mode]) if m in supported), None)


def matches(tok: Column, text: str, mode: str, case_sensitive: bool = False) -> Column:
    """Whether a token matches; tokens of a case-insensitive index are in lower case."""
    q = F.lit(text) if case_sensitive else F.lower(F.lit(text))
    if mode == EXACT:
        return tok == q
    if mode == PREFIX:
        return tok.startswith(q)
    if mode == SUFFIX:
        return tok.endswith(q)
    if mode == SUBSTRING:
        return tok.contains(q)
    raise UnsupportedFeature(f"match mode {mode}")
