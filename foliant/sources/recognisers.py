"""Where recognition plugs in. The engine itself starts at recognised tokens or text; it decodes no pixels."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

#: Columns of tokens that layout operators take.
TOKENS = "doc_id bigint, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, quad_slope double, confidence double"


class Recogniser(Protocol):
    """Turns pages (doc_id, page, content binary) into tokens of the schema above."""

    def tokens(self, pages: DataFrame) -> DataFrame: ...
