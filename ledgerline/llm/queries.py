"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, op11_collocations
from .langid import op9_langid
from .mixing import OP8_SQL, op8_mixing
from .near_dups import op6_near_dups
from .neighbours import op2_neighbours
from .packing import op3_packing
from .periodic import op12_periodic
from .quality import OP1_SQL, op1_quality
from .rollups import OP7_SQL, op7_rollups
from .sharding import OP5_SQL, op5_sharding
from .suffixes import op4_suffixes
from .urls import OP10_SQL, op10_urls
from .warc import OP13_SQL, op13_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_neighbours": op2_neighbours,
        "op3_packing": op3_packing,
        "op4_suffixes": op4_suffixes,
        "op5_sharding": op5_sharding,
        "op6_near_dups": op6_near_dups,
        "op7_rollups": op7_rollups,
        "op8_mixing": op8_mixing,
        "op9_langid": op9_langid,
        "op10_urls": op10_urls,
        "op11_collocations": op11_collocations,
        "op12_periodic": op12_periodic,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1_SQL, "op5_sharding": OP5_SQL, "op7_rollups": OP7_SQL, "op8_mixing": OP8_SQL, "op10_urls": OP10_SQL, "op11_collocations": OP11_SQL, "op13_warc": OP13_SQL}
