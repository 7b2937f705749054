"""Marked-up views of detected, anonymized and restored texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import OTHER_COLOUR, TYPE_COLOURS
from ..functions.text import html_escape, let, literal_map, percent
from . import spans as sp


# The markup of both views.
def _mark(span: Column) -> Column:
    kind = html_escape(span["entity_type"])
    colour = F.coalesce(F.element_at(literal_map(TYPE_COLOURS), span["entity_type"]), F.lit(OTHER_COLOUR))
    return F.concat(
        F.lit('<mark style="background-color: '), colour, F.lit("20; border: 1px solid "), colour,
        F.lit('; border-radius: 3px; padding: 1px 4px;" data-entity="'), kind,
        F.lit('" title="'), kind, F.lit(" ("), percent(span["score"]), F.lit(')">'),
        html_escape(span["text"]), F.lit("</mark>"),
    )


def _short_mark(span: Column) -> Column:
    kind = span["entity_type"]
    return F.concat(
        F.lit('<mark class="entity-mark entity-'), kind, F.lit('" title="'), html_escape(kind), F.lit('">'),
        html_escape(span["text"]), F.lit("</mark>"),
    )


def _render(text: Column, spans: Column, mark) -> Column:
    return let(spans, lambda s: sp.splice(text, s, F.transform(s, mark), html_escape))


def annotate_html(text: Column, spans: Column) -> Column:
    """Escaped text with a coloured mark around each span; the best of overlapping spans is shown."""
    return _render(text, sp.resolve_overlaps(spans), _mark)


def annotate_html_first_wins(text: Column, spans: Column) -> Column:
    """The same with class names only; of overlapping spans the first one is shown."""
    return _render(text, sp.first_wins(spans), _short_mark)


def placeholders(text: Column) -> Column:
    """Names inside square brackets, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[(\w+?)\]"), F.lit(1))
