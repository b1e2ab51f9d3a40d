"""Line and word splitting with the contracts of a line reader and a
single-space ``split``.

Lines: a text is read as a stream would read it. ``\\n``, ``\\r`` and
``\\r\\n`` end a line; a terminator at the very end does not start another
line, and an empty text has no lines.

Words: a line is split on each single space. Empty tokens between or before
spaces are kept, trailing empty tokens are dropped, so ``"a  b"`` gives
``a, "", b``, ``"  a"`` gives ``"", "", a``, ``""`` gives one empty word and
``"   "`` gives none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE_BREAK = r"\r\n|\r|\n"


def split_lines(text: Column) -> Column:
    """ARRAY<STRING> of the lines of ``text``.

    Text without carriage returns takes a plain split on line feeds; only
    text with carriage returns needs the regular expression.
    """
    lf_body = F.when(text.endswith("\n"), text.substr(F.lit(1), F.length(text) - 1)) \
        .otherwise(text)
    any_body = F.regexp_replace(text, r"(\r\n|\r|\n)\z", "")
    return (F.when(text == "", F.array().cast("array<string>"))
            .when(~text.contains("\r"), F.split(lf_body, "\n", -1))
            .otherwise(F.split(any_body, _LINE_BREAK, -1)))


def space_tokens(line: Column) -> Column:
    """ARRAY<STRING> of the single-space tokens of ``line``."""
    stripped = F.rtrim(line)  # trims ASCII spaces only
    return F.when((line != "") & (stripped == ""), F.array().cast("array<string>")).otherwise(
        F.split(stripped, " ", -1))
