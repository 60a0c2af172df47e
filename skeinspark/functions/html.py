"""Text of HTML pages: one scan over markup, with runs of text between.

The scan knows comments, declarations, raw elements (``script`` and the like), tags with
quoted attributes, and elements whose content is text (``title``, ``textarea``). What it
matches is not scanned again, so text that looks like markup once decoded stays text.
Every alternative is possessive or ends at the end of the page, so a page is scanned in
time in proportion to its length, however broken it is.
"""

from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers get this module with the function, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Elements that begin and end a line, and those whose content is no text. Names fixed by the HTML standard.
BLOCKS = (
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul"
).split()
DROPPED = ("script", "style", "noembed", "noframes", "iframe", "xmp")
TEXTUAL = ("title", "textarea")

_ATTRIBUTES = r"""(?:[^>"'=]++|=[ ]?(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+"""
_END = r"(?=[ />]|\Z)"
_MARKUP = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<dropped>{"|".join(DROPPED)}){_END}{_ATTRIBUTES}(?:\Z|>.*?(?:</(?P=dropped){_END}[^>]*+(?:>|\Z)|\Z))
    |<(?P<textual>{"|".join(TEXTUAL)}){_END}{_ATTRIBUTES}(?:\Z|>(?P<content>.*?)(?:</(?P=textual){_END}[^>]*+(?:>|\Z)|\Z))
    |</?(?P<tag>[a-z][^ />]*+){_ATTRIBUTES}(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""".replace("\n    ", ""),
    re.I | re.S,
)
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_BLOCKS = frozenset(BLOCKS)


def _stands_for(m: re.Match) -> str:
    """A line break for a block, a mark (NUL) for what leaves the line as it is."""
    if tag := m["tag"]:
        return "\n" if tag.lower() in _BLOCKS else "\0"
    if m["content"] is not None:
        return f"\n{m['content']}\n" if m["textual"].lower() in _BLOCKS else f"\0{m['content']}\0"
    return "\0"


_LINES, _SPACES = re.compile(r"[\0 ]*\n[\0 \n]*"), re.compile(r"[\0 ]* [\0 ]*")


def page_text(page: str) -> str:
    """The text of one page, a line for each block.

    Runs of blanks are one space, lines are trimmed and empty lines left out; character
    references are decoded last, so blanks and ``<`` that are written as such stay. What is
    not closed (a comment, a raw element, a tag, a quoted value) goes on to the end of the
    page; a ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text.
    """
    told = _MARKUP.sub(_stands_for, _BLANKS.sub(" ", page.replace("\0", "")))
    told = _SPACES.sub(" ", _LINES.sub("\n", told)).strip("\0 \n")
    return (html.unescape(told) if "&" in told else told).replace("\0", "")


def html_text(column: Column | str) -> Column:
    """Text of a column of pages, batch by batch in Arrow; null stays null, an empty page has an empty text."""

    @F.arrow_udf("string")
    def of_batch(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else page_text(p) for p in pages.to_pylist()], pa.string())

    return of_batch(column)
