"""Main text of web pages by wrappers that are inferred for each host.

Every task aligns the pages it reads to one wrapper a host
(:mod:`quillmark.llm.wrappers`); only these, a few KB each, are exchanged and
aligned with each other, in two levels, so a host with a third of all pages is
shared by all tasks that read it. The host's wrapper then says which slots are
main text, and each page is read by it where it stands.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import wrappers as W
from quillmark.llm.tables import staged
from quillmark.operators.joins import sized_broadcast_join

#: Hosts that one task holds wrappers of before it hands them out.
HELD_HOSTS = 2_000


def host_of(url):
    """Host name of a URL, lower-cased, without user and port (none: empty)."""
    name = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(name, F.lit(""))


def _out(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()),
                                       pa.array([W.dumped(w) for w in held.values()], pa.string())],
                                      names=["host", "wrapper"])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, page`` rows to ``host, wrapper`` rows."""
    held: dict = {}
    for batch in batches:
        for host, page in zip(batch.column(0), batch.column(1), strict=True):
            if not (text := page.as_py()):
                continue
            key, w = (host.as_py(),), W.inferred(W.parse(text))
            held[key] = W.merged(held[key], w) if key in held else w
            if len(held) >= HELD_HOSTS:
                yield _out(held)
                held = {}
    yield _out(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``host, share, wrapper`` rows to one wrapper for each host and share."""
    key, now = None, None
    for batch in batches:
        for host, share, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = json.loads(text)
            if (host, share) == key:
                now = W.merged(now, w)
            else:
                if key is not None:
                    yield _out({key: now})
                key, now = (host, share), w
    if key is not None:
        yield _out({key: now})


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: the wrapper (JSON) of every host in ``url, html`` rows.

    Pages without a URL are of the host ''; null and empty pages are not
    aligned. The order of alignment follows the wrappers' texts, not the
    order in which tasks end.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").alias("page"))
    parts = staged(rows.mapInArrow(_infer, "host string, wrapper string"), "wrappers-of-tasks")
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    shares = math.ceil(math.sqrt(most))
    share = F.pmod(F.xxhash64("wrapper"), F.lit(shares))
    for s in (share, F.lit(0).cast("bigint")):
        parts = (parts.select("host", s.alias("share"), "wrapper").repartition("host", "share")
                 .sortWithinPartitions("host", "share", "wrapper").mapInArrow(_merge, "host string, wrapper string"))
    return parts


@lru_cache(maxsize=1000)
def _plan(text: str) -> dict:
    return W.plan_of(text)


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [json.dumps(W.chosen(json.loads(w.as_py())), ensure_ascii=False) for w in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plans, pa.string())], names=["host", "plan"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, plan in zip(batch.column("html"), batch.column("plan"), strict=True):
            page, plan = page.as_py(), plan.as_py()
            texts.append(W.main_text(W.parse(page), _plan(plan)) if page and plan else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def extracted_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of every row of ``pages``.

    Null and empty pages, and pages without main text, have an empty text;
    pages are read whole; repeated rows and null ids are rows like others;
    other columns are not read; an empty table gives no rows.
    """
    plans = staged(host_wrappers(pages).mapInArrow(_plans, "host string, plan string"), "plans")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        "html", host_of(F.col("url")).alias("host"))
    rows = sized_broadcast_join(rows, plans, ["host"], "left", salt_by=["page_id", "html"])
    return rows.select("page_id", "url", "html", "plan").mapInArrow(_extract, "page_id bigint, url string, text string")


def op11_pages(spark, sf_dir: str) -> DataFrame:
    from quillmark.llm.tables import table
    return extracted_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
