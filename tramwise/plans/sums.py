"""Derived tables of a set of tables, without a load."""

from __future__ import annotations

import tempfile
from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ..schema import DERIVED_LAYOUTS
from ..session import checkpoint_root
from ..sources.tables import Tables
from .refresh import DERIVED


def with_sums(t: Tables) -> Tables:
    """``t`` with its derived tables, each written to the shared folder when first read.

    What reads them sees stored rows only, never the facts. Stored tables have them
    already, see :func:`refresh.current`.
    """

    def stored(name: str) -> DataFrame:
        fact, derive = DERIVED[name]
        rows = derive(getattr(t, fact))
        spark = rows.sparkSession
        path = f"{_folder(spark)}/{name}-{uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.schema(DERIVED_LAYOUTS[name]).parquet(path)

    return t.with_(**{name: partial(stored, name) for name in DERIVED})


def _folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode one of our own."""
    local = spark.sparkContext.master.startswith("local[")
    unset = spark.conf.get("spark.checkpoint.dir", None) is None
    return checkpoint_root(spark, tempfile.mkdtemp(prefix="sums-") if local and unset else None)
