"""Prose blocks of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import pages as P
from prosemill.plans.registry import query, table

_SQL = "html"
for _tag in P.SKIPPED:
    _SQL = rf"regexp_replace({_SQL}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', '', 'g')"
_SQL = rf"regexp_replace(regexp_replace({_SQL}, '(?i)</?(?:{P.BLOCKS})\b[^>]*>', chr(1), 'g'), '<[^>]+>', '', 'g')"
_BLOCKS = rf"list_filter(list_transform(string_split({_SQL}, chr(1)), lambda x: trim(regexp_replace(x, '[\s\v]+', ' ', 'g'))), lambda x: length(x) > 20)"


@query(f"SELECT page_id, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS nth FROM (SELECT page_id, {_BLOCKS} AS bs FROM pages)")
def page_blocks(s, d):
    b = table(s, d, "pages").select("page_id", F.posexplode_outer(P.blocks(F.col("html"))).alias("nth", "block")).filter("nth is not null")
    return b.select("page_id", "block", F.col("nth").cast("long").alias("nth"))
