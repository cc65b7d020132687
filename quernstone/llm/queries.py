"""Registry of the subpackage's queries and their SQL."""

from __future__ import annotations

from . import arc_convert, decontaminate, hard_negatives, html_extract, language_id, license_scan, near_dedup, packing, suffix_dedup, toxicity, turn_repair, url_filter, vector_lists
from .common import narrow_batches

_MODULES = (arc_convert, decontaminate, hard_negatives, html_extract, language_id, license_scan, near_dedup, packing, suffix_dedup, toxicity, turn_repair, url_filter, vector_lists)


def _narrowed(query):
    def run(spark, sf_dir):
        narrow_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _narrowed(query) for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
