"""Value sets from rows: expansion by URL, by text filter, and a short-lived cache."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Terminology:
    """Expansions over ``rows``: url, system, code, display.

    An expansion is kept for ``seconds`` and asked for anew afterwards, so a
    changed value set shows after that time at the latest.
    """

    def __init__(self, rows: Callable[[], DataFrame], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self._rows, self._seconds, self._clock = rows, seconds, clock
        self._kept: dict[str, tuple[float, DataFrame]] = {}

    def expand(self, url: str) -> DataFrame | None:
        """(system, code, display) of a value set; None if nobody knows it."""
        now = self._clock()
        for name in [u for u, (until, _) in self._kept.items() if until <= now]:
            self._kept.pop(name)[1].unpersist()
        if url not in self._kept:
            found = self._rows().where(F.col("url") == url).select("system", "code", "display").distinct().persist()
            if not found.take(1):
                found.unpersist()
                return None
            self._kept[url] = (now + self._seconds, found)
        return self._kept[url][1]

    def matching(self, url: str, text: str, count: int | None = None, offset: int = 0) -> DataFrame | None:
        """Of an expansion the concepts whose display or code holds the text, whatever its case, in order of system and code."""
        found = self.expand(url)
        if found is None:
            return None
        wanted = F.lit(text.lower())
        held = F.coalesce(F.contains(F.lower("display"), wanted), F.lit(False)) | F.contains(F.lower("code"), wanted)
        rows = found.where(held).orderBy("system", "code").offset(offset)
        return rows if count is None else rows.limit(count)
