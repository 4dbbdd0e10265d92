"""Identity of documents against the names and aliases of events: an Aho-Corasick automaton over all names, one pass a document.

Names and texts are compared in their identity form (NFKC, lower case, letters and digits only); shorter names than three characters identify
nothing. Names go out in blocks bounded in number and characters; for each block every document is walked once, however many names the
block has, and gives each event at most once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain
from ..functions.unicode import identity_text

#: Bounds of a block: what an executor holds as an automaton.
BLOCK_NAMES, BLOCK_CHARS = 100_000, 4 << 20
SHORTEST = 3
#: Hits that a task holds before it gives them on.
BATCH_HITS = 10_000


def identity_names(events: DataFrame) -> DataFrame:
    """``event_id, name``: distinct identity forms of ``names`` (array), without those too short."""
    each = events.select("event_id", F.explode("names").alias("n")).select("event_id", identity_text(F.col("n")).alias("name"))
    return each.where(F.length("name") >= SHORTEST).distinct()


def _blocks(names: DataFrame) -> Iterator[list[tuple[str, list]]]:
    """Names with their events, a bounded block at a time; rows come from the executors as they are taken."""
    block: list[tuple[str, list]] = []
    size = 0
    # a name of very many events is cut into rows of bounded length
    rows = names.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(64))).groupBy("name", "part").agg(F.collect_set("event_id").alias("events"))
    for r in rows.toLocalIterator():
        block.append((r["name"], r["events"]))
        size += len(r["name"]) + 8 * len(r["events"])
        if len(block) >= BLOCK_NAMES or size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def name_hits(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, event_id`` for every document and each event of which it holds a name; documents with equal keys are one."""
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    of = names.schema["event_id"].dataType.simpleString()
    hay = documents.select(F.col(key).alias("k"), identity_text(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    out = spark.createDataFrame([], f"{key} {kind}, event_id {of}")
    for block in _blocks(names):
        shared = spark.sparkContext.broadcast(block)  # bounded by the block's limits

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for name, events in shared.value:
                automaton.add_word(name, automaton.get(name, []) + list(events))
            automaton.make_automaton()
            def found(keys: list, hits: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(hits, EVENT_TYPES[of])], [key, "event_id"])

            for batch in batches:
                keys, events = [], []
                for k, t in zip(*batch.columns):  # a batch of long texts is never held as Python strings
                    hits = {e for _, own in automaton.iter(t.as_py()) for e in own}
                    keys += [k.as_py()] * len(hits)
                    events += hits
                    if len(keys) >= BATCH_HITS:
                        yield found(keys, events)
                        keys, events = [], []
                yield found(keys, events)

        out = out.unionByName(hay.mapInArrow(walk, out.schema))
    return out.distinct()


EVENT_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def document_identity(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Verdict of each document for the edition that it was fetched for: ``edition_id, source_id, status, evidence``.

    records: ``event_id, edition_id, edition_year, names`` (event name, edition name, aliases), ``category_names``. documents:
    ``edition_id, source_id, source_domain, title, text, url`` and for structured ones ``category_name, track_url``. A document without an
    event name or from another domain is rejected; one without the year is uncertain; the track of a structured one must name its
    category, which the edition must have, and one year, the edition's.
    """
    docs = documents.withColumn("_doc", F.xxhash64("edition_id", "source_id", "url", "text"))
    pages = docs.select("_doc", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), "url").alias("text"))
    wanted = docs.select("edition_id").distinct().join(records, "edition_id")
    hits = name_hits(pages, identity_names(wanted.select("event_id", "names")), "_doc").withColumn("_named", F.lit(True))
    rows = docs.join(records, "edition_id").join(hits, ["_doc", "event_id"], "left")
    year = F.col("edition_year").cast("string")
    hay = identity_text(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), "url"))
    host = domain(F.col("url"))
    named, dated, at_home = F.coalesce("_named", F.lit(False)), F.contains(hay, year), F.coalesce(host == F.regexp_replace(F.lower(F.trim("source_domain")), r"^www\.", ""), F.lit(False))
    track = F.try_url_decode(F.regexp_extract(F.regexp_extract("track_url", r"^[^?#]*", 0), r"[^/]*$", 0))
    years = F.regexp_extract_all(track, F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), 1)
    structured = F.col("track_url").isNotNull()
    fits = F.coalesce(F.contains(track, F.col("category_name")) & F.array_contains("category_names", F.col("category_name")), F.lit(False))
    conflict = structured & (~fits | F.exists(years, lambda y: y != year))
    several = structured & (F.size(years) != 1)
    tag = lambda c, yes, no: F.when(c, yes).otherwise(no)
    basic = F.array(tag(named, "event_name_or_alias_matched", "event_name_or_alias_missing"), tag(dated, "edition_year_matched", "edition_year_missing"), tag(at_home, "approved_domain_matched", "approved_domain_mismatch"))
    more: Column = F.when(conflict, F.array(F.lit("structured_category_or_edition_conflict"))).when(several, F.array(F.lit("structured_edition_year_not_unique"))).otherwise(F.array().cast("array<string>"))
    status = F.when(~named | ~at_home, "rejected").when(conflict, "rejected").when(several, "uncertain").when(~dated, "uncertain").otherwise("matched")
    return rows.select("edition_id", "source_id", "url", status.alias("status"), F.concat(basic, F.when(named & at_home, more).otherwise(F.array().cast("array<string>"))).alias("evidence"))
