"""Applying changes in order, each against what the earlier ones left, with its evidence checked again.

The changes of an edition are folded in the order of ``seq``. The fold carries the edition's values and its sources as they are then: a
change that withdraws a source or renews its document takes the ground from later changes that quote it, and one that moves a value makes
later ones stale. Changes stream through a task sorted by edition and order; only one edition's values and sources are held.

Tables:

* snapshot: ``event_id, edition_id, category_id, entity_type, field, value``; a category exists if it has a row
* sources: ``edition_id, source_id, url, content_hash, eligible, auto`` (boolean: may be extracted, may be applied without review)
* changes: ``seq, change_id, event_id, edition_id, category_id, entity_type, field, old_value, new_value, risk, action, conflict, evidence``
  with evidence ``array<struct<source_id, source_url, content_hash, evidence_text, evidence_locator, confidence double>>``. Entity ``Source`` changes a source
  itself: ``category_id`` is the source, ``field`` is ``status`` (``new_value`` withdrawn) or ``content_hash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import field_value_issues

OUT = "kind string, change_id string, outcome string, event_id string, edition_id string, category_id string, entity_type string, field string, value string, sources string, confidence double"
HASH = r"^[a-f0-9]{64}\z"
LOW, REVIEWED = ("low",), ("low", "high_impact")
NOTHING = (None, None)


class Edition:
    """The values and sources of one edition while its changes are folded."""

    def __init__(self, edition_id: str):
        self.edition_id, self.events = edition_id, set()
        self.values: dict[tuple, str | None] = {}
        self.entities: set[tuple] = set()
        self.sources: dict[str, list] = {}  # url, content hash, eligible, auto
        self.touched: dict[tuple, tuple[str, float]] = {}

    def ground(self, source_id: str, url: str, content_hash: str | None, complete: bool, reviewed: bool) -> str | None:
        """Why a quoted source gives no ground now."""
        source = self.sources.get(source_id)
        if source is None or source[0] != url:
            return "unregistered"
        if not source[2] or not (reviewed or source[3]):
            return "not_eligible"
        if not complete:
            return "incomplete"
        return None if source[1] is None or source[1] == content_hash else "document_changed"

    def refusal(self, event: str, category: str, entity: str, target: tuple, old_value: str | None) -> str | None:
        """Why a change with sound evidence can't be applied now."""
        if event not in self.events:
            return "target"
        if entity == "Source":
            return None if category in self.sources else "target"
        if (entity, category) not in self.entities:
            return "target"
        return None if self.values.get(target) == old_value else "stale"

    def apply(self, category: str, entity: str, field: str, target: tuple, new_value: str | None, sources: list[str], confidences: list[float]) -> None:
        if entity == "Source":
            source = self.sources[category]
            if field == "content_hash":
                source[1] = new_value
            elif field == "status" and new_value != "active":
                source[2] = False
            return
        self.values[target] = new_value
        self.touched[target] = (",".join(sources), min(confidences))


def refused(reviewed: bool) -> Column:
    """The reason against a change that doesn't depend on the changes before it; the first one counts, null without one."""
    c = F.col
    automatic = c("risk").isin(*LOW) & (c("action") == "auto_apply")
    by_hand = c("risk").isin(*REVIEWED) & (c("action") == "pending_review") if reviewed else F.lit(False)
    other = ~c("entity_type").eqNullSafe("Edition") if not reviewed else F.lit(False)
    issues = field_value_issues(c("field"), c("new_value"))
    return (
        F.when(c("conflict"), "conflict").when(~F.coalesce(automatic | by_hand, F.lit(False)), "policy").when(other, "entity_policy")
        .when(F.coalesce(~c("entity_type").eqNullSafe("Source") & (issues != ""), F.lit(False)), F.concat(F.lit("value:"), issues))
        .when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_evidence")
    )


def complete(e: Column) -> Column:
    """A piece of evidence that says all it must: text, place, hash of its document, confidence."""
    said = lambda x: F.coalesce(x.rlike(r"(?U)[^\s\ufeff]"), F.lit(False))
    return said(e["evidence_text"]) & said(e["evidence_locator"]) & F.coalesce(e["content_hash"].rlike(HASH) & (e["confidence"] >= 0) & (e["confidence"] <= 1), F.lit(False))


def values(column: pa.Array) -> list:
    """Python values of a flat column; by NumPy, which makes no scalar of each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def apply_in_order(snapshot: DataFrame, sources: DataFrame, changes: DataFrame, reviewed: bool = False) -> DataFrame:
    """``kind = 'value'`` rows of the new snapshot (with the sources and least confidence of values that moved) and ``kind = 'change'`` rows with
    each change's ``outcome``: ``applied`` or the reason why it was refused.

    What doesn't depend on earlier changes is decided by columns before the shuffle. A row then has flat columns, and the columns that a change keeps
    go through a task as Arrow columns; a Python value is made only of what the fold reads.
    """
    c = F.col
    why, none = refused(reviewed), F.lit(None).cast("string")
    proof = F.when(c("why").isNull(), c("evidence"))  # a refused change needs none
    part = lambda name: F.transform(proof, lambda e: e[name]).alias(name)
    target = ("event_id", "edition_id", "category_id", "entity_type", "field")
    streams = [
        sources.select("edition_id", F.lit(0).alias("step"), c("source_id").alias("category_id"), c("url").alias("value"), c("content_hash").alias("old_value"), "eligible", "auto"),
        snapshot.select(*target, F.lit(1).alias("step"), "value"),
        changes.withColumn("why", why).select(
            *target, F.lit(2).alias("step"), "seq", "change_id", c("new_value").alias("value"), "old_value", "why", part("source_id"), part("source_url"), part("content_hash"), F.transform(proof, complete).alias("complete"), part("confidence"),
        ),
    ]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), streams)
    ordered = rows.repartition("edition_id").sortWithinPartitions("edition_id", "step", "seq", "change_id").drop("seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edition: Edition | None = None
        closed: list[tuple] = []
        names = [f.split()[0] for f in OUT.split(", ")]
        types = [pa.string()] * 10 + [pa.float64()]

        def close(e: Edition) -> None:
            for key, value in e.values.items():
                event, category, entity, name = key
                closed.append(("value", None, None, event, e.edition_id, category, entity, name, value, *e.touched.get(key, NOTHING)))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*closed), types)], names)
            closed.clear()
            return made

        for batch in batches:
            flat = {n: values(batch.column(n)) for n in ("edition_id", "step", "event_id", "category_id", "entity_type", "field", "value", "old_value", "why", "eligible", "auto")}
            lists = [batch.column(n) for n in ("source_id", "source_url", "content_hash", "complete", "confidence")]
            at, parts = lists[0].value_lengths().fill_null(0).to_numpy().tolist(), [values(x.flatten()) for x in lists]
            start, outcome = 0, []
            for (edition_id, step, event, category, entity, field, value, old, why, eligible, auto), n in zip(zip(*flat.values()), at):
                if edition is None or edition_id != edition.edition_id:
                    if edition is not None:
                        close(edition)
                    edition = Edition(edition_id)
                if step == 0:
                    edition.sources[category] = [value, old, eligible, auto]
                elif step == 1:
                    edition.values[event, category, entity, field] = value
                    edition.events.add(event)
                    edition.entities.add((entity, category))
                else:
                    if why is None:
                        for k in range(start, start + n):
                            if bad := edition.ground(parts[0][k], parts[1][k], parts[2][k], parts[3][k], reviewed):
                                why = f"evidence:{bad}"
                                break
                        else:
                            key = (event, category, entity, field)
                            why = edition.refusal(event, category, entity, key, old)
                            if why is None:
                                edition.apply(category, entity, field, key, value, parts[0][start : start + n], parts[4][start : start + n])
                    outcome.append(why or "applied")
                start += n
                if len(closed) >= 10_000:
                    yield flush()
            kept = batch.filter(pc.equal(batch.column("step"), 2))
            if outcome:
                fixed = {"kind": pa.array(["change"] * len(outcome)), "outcome": pa.array(outcome, pa.string()), "sources": pa.nulls(len(outcome), pa.string()), "confidence": pa.nulls(len(outcome), pa.float64())}
                yield pa.RecordBatch.from_arrays([fixed[n] if n in fixed else kept.column(n).cast(t) for n, t in zip(names, types)], names)
        if edition is not None:
            close(edition)
        if closed:
            yield flush()

    return ordered.mapInArrow(fold, OUT)
