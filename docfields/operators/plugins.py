"""Contracts of the stages that need libraries this package does not ship: decoding, OCR, classifiers, generators.

A provider is a function over pandas frames; the engine runs it with ``mapInPandas`` and holds it
to the columns below.  Everything after a provider is a plain plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

if TYPE_CHECKING:
    import pandas as pd

Provider = Callable[["pd.DataFrame"], "pd.DataFrame"]
WORD_SCHEMA = "key string, word_idx long, text string, x int, y int, w int, h int, conf double"
LABEL_SCHEMA = "key string, word_idx long, sub int, label string, prob double"
TEXT_SCHEMA = "key string, generated string"
IMAGE_SCHEMA = "path string, content binary, status string"


def run(df: DataFrame, provider: Provider, schema: str) -> DataFrame:
    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield provider(frame)

    return df.mapInPandas(apply, schema)


def clean_images(images: DataFrame, provider: Provider) -> DataFrame:
    """(path, content, status) of cleaned pages; the provider sets status to success or failed."""
    return run(images, provider, IMAGE_SCHEMA)


def ocr_words(images: DataFrame, provider: Provider, least: float = 30) -> DataFrame:
    """Word rows of pages, blank and doubtful words dropped."""
    words = run(images, provider, WORD_SCHEMA)
    return words.where((N.trimmed("text") != "") & (F.coalesce("conf", F.lit(-1.0)) > least))


def predict_labels(words: DataFrame, provider: Provider) -> DataFrame:
    """Sub-word labels with probabilities for whole pages: the provider sees a page's words together."""
    return words.groupBy("key").applyInPandas(lambda frame: provider(frame), LABEL_SCHEMA)


def generate_text(images: DataFrame, provider: Provider) -> DataFrame:
    return run(images, provider, TEXT_SCHEMA)
