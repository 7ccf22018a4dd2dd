"""Paged documents through an injected parser, which is loaded once per worker; no parser is included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

WORDS = "file string, page int, x0 double, y0 double, x1 double, y1 double, text string"
PAGES = "file string, page int, height int, width int, rgb binary"


def page_words(files: DataFrame, load: Callable[[], Callable[[bytes], list[list[tuple]]]]) -> DataFrame:
    """The words of `files` (path, content) with their boxes, WORDS; a document that fails has none. Feeds clustering.page_rows()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = load()
        for frame in frames:
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    pages = parse(bytes(content))
                except Exception:
                    pages = []
                rows = [(path, k, *map(float, w[:4]), str(w[4])) for k, words in enumerate(pages, 1) for w in words]
                yield pd.DataFrame(rows, columns=["file", "page", "x0", "y0", "x1", "y1", "text"])

    return files.select("path", "content").mapInPandas(run, WORDS)


def page_pictures(files: DataFrame, load: Callable[[], Callable[[bytes], list]], most: int = 100) -> DataFrame:
    """Pictures of the first `most` pages of each document (a limit of the operator), PAGES; a renderer returns arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = load()
        for frame in frames:
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    pages = render(bytes(content))[:most]
                except Exception:
                    pages = []
                rows = [(path, k, x.shape[0], x.shape[1], x.tobytes()) for k, x in enumerate(pages, 1)]
                yield pd.DataFrame(rows, columns=["file", "page", "height", "width", "rgb"])

    return files.select("path", "content").mapInPandas(run, PAGES)
