"""Streams over the driver's tables; each is held against its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.plans.corpus_queries import BAND, CHOSEN, HITS
from prosemill.plans.registry import query
from prosemill.plans.text_queries import CAP, REASON, SENTENCES, TOKENS, band, docs
from prosemill.streaming import streams


@query(f"SELECT form, count(*) AS n FROM ({TOKENS}) GROUP BY form")
def stream_word_counts(s, d):
    return streams.collected(streams.word_counts(streams.documents(s, d)), "complete")


@query("SELECT DISTINCT md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')) AS key FROM documents")
def stream_dedup(s, d):
    return streams.collected(streams.distinct_texts(streams.documents(s, d)), "append")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_windows(s, d):
    out = streams.collected(streams.windowed_events(streams.documents(s, d, "events")), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query(f"WITH {SENTENCES}, {REASON}, {BAND}, {HITS}, {CHOSEN} SELECT doc_id, sent_no, sentence FROM kept SEMI JOIN chosen USING (pos)")
def stream_coverage(s, d):
    kept = streams.coverage(s, streams.documents(s, d), band(docs(s, d)).select("form"), CAP)
    return kept.select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), "sentence")


@query("SELECT count(*) AS rows, 1 AS in_order FROM documents")
def stream_progress(s, d):
    """Rows that the micro-batches took, and whether their numbers rise without a gap."""
    p = streams.progress(streams.documents(s, d))
    return p.agg(F.sum("rows").alias("rows"), (F.max("batch") - F.min("batch") + 1 == F.count("*")).cast("int").alias("in_order"))
