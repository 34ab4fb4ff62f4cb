"""What registered queries store once for many questions: an index or a graph made from the tables of a folder.

It is kept for the session and belongs to the tables as they are: the paths, lengths and times of
their files are part of its name, so tables that change are derived anew, and what was made of
the former ones is deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from quarry.session import shared_dir
from quarry.sources import folders

_MADE: dict[tuple[str, str, str], tuple[str, str, Any]] = {}


def stamp(spark: SparkSession, sf_dir: str) -> str:
    """Names, lengths and times of the tables' files."""
    return "\n".join(folders.stamped(spark, f"{sf_dir.rstrip('/')}/*.parquet"))


def derived(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[str], Any], more: Callable[[Any], Any] | None = None) -> Any:
    """What ``make`` returns for a new folder, made by the first question about these tables; ``more`` adds to it what a question lacks."""
    key, now = (spark.sparkContext.applicationId, sf_dir, kind), stamp(spark, sf_dir)
    if key in _MADE and _MADE[key][0] != now:
        folders.delete(spark, _MADE.pop(key)[1])
    if key not in _MADE:
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        _MADE[key] = (now, path, make(path))
    if more is not None:
        _MADE[key] = (*_MADE[key][:2], more(_MADE[key][2]))
    return _MADE[key][2]


def forget(spark: SparkSession) -> None:
    """Deletes everything that this session has derived."""
    for key in [k for k in _MADE if k[0] == spark.sparkContext.applicationId]:
        folders.delete(spark, _MADE.pop(key)[1])
