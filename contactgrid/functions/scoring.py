"""Page score from path and link text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactgrid import reference_data as ref


def scoring_text(path: Column, link_text: Column) -> Column:
    return F.concat(scoring_path(path), F.lit(" "), F.lower(link_text))


def scoring_path(path: Column) -> Column:
    """Lower-case path without the parameters of its last segment."""
    return F.lower(F.when(path.contains(";"), F.regexp_replace(path, ";[^/]*$", "")).otherwise(
        path))


def _active(signal: str, path: Column, text: Column) -> Column:
    if signal == "HOME_PAGE":
        return path.isin(*ref.HOME_PATHS)
    words = ref.PAGE_SIGNALS[signal][1]
    # a word that contains another word of its signal adds nothing
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    hit = text.contains(needed[0])
    for word in needed[1:]:
        hit = hit | text.contains(word)
    return hit


def page_signals(path: Column, text: Column) -> Column:
    """Sorted names of the active signals; `path` and `text` as built above."""
    names = [F.when(_active(s, path, text), F.lit(s)) for s in sorted(ref.PAGE_SIGNALS)]
    return F.array_compact(F.array(*names))


def score_of(signals: Column) -> Column:
    """Sum of the weights of the given signals."""
    weights = F.create_map(*[
        F.lit(x) for name, (weight, _) in ref.PAGE_SIGNALS.items() for x in (name, weight)])
    return F.aggregate(signals, F.lit(0), lambda total, s: total + F.element_at(weights, s))


def page_score(path: Column, text: Column) -> Column:
    return score_of(page_signals(path, text))
