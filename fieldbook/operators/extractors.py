"""Fact extraction from documents by pluggable extractors, as a Python table function over a partitioned table argument.

An extractor is set up once for each partition of the argument (a source, or a salted part of one), reads its documents one at a time and
answers each with an envelope that :func:`evidence.decode_facts` checks. A document that fails gives a row with its error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .evidence import CONTRACT, decode_facts


class FactExtractor(Protocol):
    """``open`` is called once for a partition, with its first document; ``extract`` gives the facts of one document."""

    id: str
    model: str
    version: str

    def open(self, document: dict[str, Any]) -> None: ...

    def extract(self, document: dict[str, Any]) -> list[dict[str, Any]]: ...


OUTPUT = "source_id string, url string, content_hash string, provider string, model string, prompt_version string, body string, error string"


def extraction(documents: DataFrame, make: Callable[[], FactExtractor], salts: int = 1) -> DataFrame:
    """Outputs of an extractor: one row for each document ``source_id, url, content_hash, ...``.

    ``salts`` splits the documents of each source over so many partitions (by their address), for sources with a large share of all.
    """

    @udtf(returnType=OUTPUT)
    class Extract:
        def __init__(self) -> None:
            self.extractor: FactExtractor | None = None
            self.refused: str | None = None

        def eval(self, row: Row) -> Iterator[tuple]:
            document = row.asDict(recursive=True)
            name = (document["source_id"], document["url"], document["content_hash"])
            if self.extractor is None and self.refused is None:
                try:
                    self.extractor = make()
                    self.extractor.open(document)
                except Exception as e:  # noqa: BLE001 a partition that can't be set up says so in its rows
                    self.refused = f"setup_failed: {e}"
            if self.refused is not None:
                yield (*name, None, None, None, None, self.refused)
                return
            x = self.extractor
            try:
                body = json.dumps({"contractVersion": CONTRACT, "facts": x.extract(document)}, ensure_ascii=False)
            except Exception as e:  # noqa: BLE001 a document's failure is data here
                yield (*name, x.id, x.model, x.version, None, f"{type(e).__name__}: {e}")
            else:
                yield (*name, x.id, x.model, x.version, body, None)

    salted = documents.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(salts)))
    return Extract(salted.asTable().partitionBy("source_id", "_salt"))


def extracted_facts(documents: DataFrame, make: Callable[[], FactExtractor], salts: int = 1) -> DataFrame:
    """Checked facts of all documents; outputs that break the contract and documents that failed are rows with an ``error``."""
    out = extraction(documents, make, salts).withColumnRenamed("error", "failure")
    failed = out.where("failure is not null").drop("body").withColumn("error", F.col("failure"))
    facts = decode_facts(out.where("failure is null").drop("failure"))
    return facts.drop("body").unionByName(failed.drop("failure"), allowMissingColumns=True)


# fixed values: fields of the approved category interface, by the name of the fact
CATEGORY_FACTS = (("elevationGain", "elevationGain"), ("startLocation", "startPoint"), ("finishLocation", "endPoint"))


class CategoryJson:
    """Direct facts of an approved category interface (JSON); its distance is the course's and no fact of the category.

    Documents: ``body, event_id, edition_id, category_id`` and the approved ``group_id, group_name``.
    """

    id, model, version = "deterministic-json", "none", "category-json-v1"

    def open(self, document: dict[str, Any]) -> None:
        if not document["edition_id"]:
            raise ValueError("no edition")

    def extract(self, document: dict[str, Any]) -> list[dict[str, Any]]:
        data = self._data(document)
        name = data["name"]
        return [
            {
                "eventId": document["event_id"], "editionId": document["edition_id"], "categoryId": document["category_id"], "entityType": "Category", "field": fact, "candidateValue": data[key],
                "evidenceText": f"{name} data.{key}: {data[key]}", "evidenceLocator": f"data.{key}", "confidence": 1,
            }
            for fact, key in CATEGORY_FACTS
            if data.get(key) not in (None, "")
        ]

    @staticmethod
    def _data(document: dict[str, Any]) -> dict[str, Any]:
        parsed = json.loads(document["body"])
        data = parsed.get("data") if isinstance(parsed, dict) else None
        if not isinstance(data, dict) or parsed.get("code") != 0:
            raise ValueError("envelope")
        if data.get("id") != document["group_id"] or data.get("name") != document["group_name"]:
            raise ValueError("identity")
        number = lambda k: isinstance(data.get(k), int | float) and not isinstance(data[k], bool)
        texts = all(data.get(k) is None or isinstance(data[k], str) for k in ("startPoint", "endPoint"))
        if not (number("distance") and data["distance"] > 0 and number("elevationGain") and data["elevationGain"] >= 0 and texts and isinstance(data.get("buttons"), list)):
            raise ValueError("facts")
        links = [b.get("linkUrl") for b in data["buttons"] if isinstance(b, dict)]
        if not any(isinstance(u, str) and urlsplit(u).scheme == "https" and unquote(urlsplit(u).path).endswith(".gpx") for u in links):
            raise ValueError("track_link")
        return data


class LabelledText:
    """Facts of plain documents that name them: ``label: value`` lines. ``labels`` gives each label its field and value pattern."""

    id, model, version = "deterministic-text", "none", "labelled-text-v1"

    def __init__(self, labels: dict[str, tuple[str, str, str]]):
        """``labels``: label -> (entity, field, pattern of the value)."""
        self.labels = labels

    def open(self, document: dict[str, Any]) -> None:
        self.patterns = [(label, entity, name, re.compile(rf"^{re.escape(label)}[:：]\s*({value})\s*$", re.M)) for label, (entity, name, value) in self.labels.items()]

    def extract(self, document: dict[str, Any]) -> list[dict[str, Any]]:
        facts = []
        for label, entity, name, pattern in self.patterns:
            if hit := pattern.search(document["body"] or ""):
                facts.append({
                    "eventId": document["event_id"], "editionId": document["edition_id"], "categoryId": document["category_id"] if entity == "Category" else None, "entityType": entity, "field": name,
                    "candidateValue": hit[1], "evidenceText": hit[0], "evidenceLocator": f"text:{hit.start()}-{hit.end()}", "confidence": 1,
                })
        return facts
