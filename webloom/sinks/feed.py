"""JSON feed of extracted pages ``(url, title, content)``."""
from __future__ import annotations

from pyspark.sql import DataFrame


def write_feed(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; ``items`` from ``operators.pages.page_title_content``."""
    items.select("url", "title", "content").write.mode(mode).json(path)
