"""Table functions, the page source and stateful streams."""

import datetime as dt
import json
import random

import pytest

from fieldbook.operators import extractors as ex
from fieldbook.operators import state
from fieldbook.sources import landed
from fieldbook.streaming import evidence_state as es

# ---------------------------------------------------------------- extraction

DOC = "source_id string, url string, content_hash string, body string, event_id string, edition_id string, category_id string, group_id bigint, group_name string"


def group(**changes):
    data = {"id": 7, "name": "50K", "distance": 51.2, "elevationGain": 2600, "startPoint": "North gate", "endPoint": None, "buttons": [{"linkUrl": "https://x.test/a%20b.gpx"}]} | changes
    return json.dumps({"code": 0, "data": data})


def documents(spark, bodies, edition="ev-2026"):
    return spark.createDataFrame([(f"s{k % 2}", f"u{k}", f"h{k}", b, "ev", edition, f"{edition}-50k", 7, "50K") for k, b in enumerate(bodies)], DOC)


def test_category_json_facts(spark):
    bad = {"envelope": json.dumps({"code": 1}), "identity": group(id=8), "facts": group(distance=0), "track_link": group(buttons=[])}
    docs = documents(spark, [group(), group(startPoint="", elevationGain=0), *bad.values(), "no json"])
    facts = ex.extracted_facts(docs, ex.CategoryJson).collect()
    good = {(r["url"], r["field"], r["candidateValue"], r["evidenceText"], r["evidenceLocator"]) for r in facts if r["error"] is None}
    assert good == {("u0", "elevationGain", "2600", "50K data.elevationGain: 2600", "data.elevationGain"), ("u0", "startLocation", '"North gate"', "50K data.startPoint: North gate", "data.startPoint"), ("u1", "elevationGain", "0", "50K data.elevationGain: 0", "data.elevationGain")}
    errors = {r["url"]: r["error"] for r in facts if r["error"]}
    assert [errors[f"u{k}"] for k in range(2, 6)] == [f"ValueError: {k}" for k in bad] and errors["u6"].startswith("JSONDecodeError")


def test_labelled_text_and_salts(spark):
    labels = {"Start": ("Category", "startLocation", ".+"), "Race day": ("Edition", "raceDate", r"\d{4}-\d{2}-\d{2}")}
    docs = documents(spark, [f"Race day: 2026-11-{k + 10}\nStart：Gate {k}\nother" for k in range(20)] + ["nothing here", None])
    for salts in (1, 8):
        facts = ex.extracted_facts(docs, lambda: ex.LabelledText(labels), salts).where("error is null").collect()
        assert len(facts) == 40 and {r["candidateValue"] for r in facts if r["field"] == "raceDate"} == {f'"2026-11-{k + 10}"' for k in range(20)}
        assert all(r["categoryId"] is None for r in facts if r["entityType"] == "Edition") and {r["provider"] for r in facts} == {"deterministic-text"}


def test_set_up_once_a_partition_and_broken_contract(spark):
    class Counting:
        id, model, version = "counting", "m", "v"

        def __init__(self):
            self.opened = 0

        def open(self, document):
            self.opened += 1

        def extract(self, document):
            return [{"opened": self.opened}]

    out = ex.extraction(documents(spark, ["x"] * 10), Counting).collect()
    assert len(out) == 10 and {r["body"] for r in out} == {'{"contractVersion": "official-fact-extraction-v1", "facts": [{"opened": 1}]}'}
    assert {r["error"] for r in ex.extracted_facts(documents(spark, ["x"] * 3), Counting).collect()} == {"schema_mismatch"}
    assert {r["error"] for r in ex.extracted_facts(documents(spark, ["x"] * 3, ""), ex.CategoryJson).collect()} == {"setup_failed: no edition"}


# ---------------------------------------------------------------- pages


def land(root, source, page, entries):
    (root / source).mkdir(exist_ok=True, parents=True)
    (root / source / f"page-{page}.json").write_text(entries if isinstance(entries, str) else json.dumps({"data": {"list": entries}}))


@pytest.fixture
def landing(spark, tmp_path):
    landed.register(spark)
    for page in (1, 2, 10):
        land(tmp_path, "alpha", page, [{"raceId": f"a{page}{k}", "raceName": f"Race {k}", "raceDate": "2026-11-01"} for k in range(3)])
    land(tmp_path, "beta", 1, [{"id": 5, "title": "Run", "city": "X"}])
    return tmp_path


def test_pages_are_partitions_and_filters_choose_files(spark, landing):
    df = spark.read.format("landed_pages").load(str(landing))
    assert df.count() == 10 and df.rdd.getNumPartitions() == 4 and df.columns == [c.split()[0] for c in landed.SCHEMA.split(", ")]
    near = spark.read.format("landed_pages").load(str(landing)).where("source = 'alpha' and page <= 2 and name <> 'Race 0'")
    assert near.rdd.getNumPartitions() == 2 and {r["raw_id"] for r in near.collect()} == {"a11", "a12", "a21", "a22"}
    row = df.where("source = 'beta'").first()
    assert (row["raw_id"], row["name"], row["location"], row["race_date"], row["place"]) == ("5", "Run", "X", None, 0)
    assert spark.read.format("landed_pages").load(str(landing / "none")).count() == 0


def test_a_broken_page_fails_its_source_only(spark, landing):
    for bad in ("{", '{"data": {"list": [1]}}', '{"data": {}}'):
        land(landing, "alpha", 2, bad)
        rows, failed = landed.by_source(spark.read.format("landed_pages").load(str(landing)))
        assert {r["source"] for r in rows.collect()} == {"beta"} and [(r["source"], r["n_failed"]) for r in failed.collect()] == [("alpha", 1)]


def test_stream_reads_each_page_once_and_goes_on_after_a_restart(spark, landing, tmp_path_factory):
    mark = str(tmp_path_factory.mktemp("mark"))
    seen = []

    def go():
        stream = spark.readStream.format("landed_pages").load(str(landing))
        q = stream.writeStream.foreachBatch(lambda b, n: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    assert len(seen) == 10
    go()
    land(landing, "alpha", 11, [{"id": "late"}])
    land(landing, "gamma", 1, [{"id": "new"}])
    go()
    assert sorted(seen, key=str) == sorted(map(tuple, spark.read.format("landed_pages").load(str(landing)).collect()), key=str) and len(seen) == 12


# ---------------------------------------------------------------- state

EVENT = "edition_id string, source_id string, at timestamp, hash string, fetched boolean, succeeded boolean, boundary timestamp"
DAY = dt.datetime(2026, 9, 1)


def events(seed=3):
    rng = random.Random(seed)
    out = []
    for s in range(6):
        at = DAY
        for _ in range(12):
            at += dt.timedelta(hours=rng.randint(5, 40))
            fetched = rng.random() < 0.8
            boundary = next((b for b in (DAY + dt.timedelta(days=4 * k, hours=s) for k in range(1, 12)) if b > at), None)
            out.append((f"e{s % 2}", f"s{s}", at, f"h{rng.randint(0, 4)}", fetched, fetched and rng.random() < 0.6, boundary))
    return sorted(out, key=lambda e: e[2])


def by_hand(rows):
    """States after each event and the ends of evidence, one source after the other."""
    states, ends = {}, set()
    for key in {r[:2] for r in rows}:
        observed = success = evidence = due = None
        for _, _, at, digest, fetched, ok, boundary in (r for r in rows if r[:2] == key):
            if evidence and due and due <= at:
                ends.add((*key, due))
                evidence = due = None
            if fetched:
                observed = digest
                if ok:
                    success, evidence, due = digest, digest, boundary
            states[(*key, at)] = (observed, success, "ok" if fetched else "failed", evidence)
        if evidence and due:
            ends.add((*key, due))
    return states, ends


def test_state_stream_with_timers_and_restart(spark, tmp_path):
    rows = events()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", es.STORE)
    inbox, mark = tmp_path / "in", str(tmp_path / "mark")
    got = []
    try:
        last = [("end", "end", DAY + dt.timedelta(days=90 + k), "h", True, False, None) for k in range(2)]  # moves the watermark past all boundaries
        for k, part in enumerate((rows[:25], rows[25:60], rows[60:], last[:1], last[1:])):
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(inbox))
            stream = spark.readStream.schema(EVENT).parquet(str(inbox))  # a new query for each part: every one is a restart
            q = es.source_evidence(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", mark).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    states, ends = by_hand(rows)
    own = [r for r in got if r["edition_id"] != "end"]
    assert {(r["edition_id"], r["source_id"], r["at"]): (r["observed_hash"], r["success_hash"], r["fetch_status"], r["evidence"]) for r in own if r["kind"] == "state"} == states
    expired = [(r["edition_id"], r["source_id"], r["at"]) for r in own if r["kind"] == "expired"]
    assert set(expired) == ends and len(expired) == len(ends)
    # the same as the batch operator, one event of each source at a time
    table = spark.createDataFrame([], "edition_id string, source_id string, observed_hash string, success_hash string, checked_at timestamp, fetch_status string")
    by_source = {k: [r for r in rows if r[:2] == k] for k in {r[:2] for r in rows}}
    for k in range(3):
        results = spark.createDataFrame([r[:6] for v in by_source.values() for r in v[4 * k : 4 * k + 4]], "edition_id string, source_id string, at timestamp, hash string, fetched boolean, succeeded boolean")
        for n in range(4):
            step = [v[4 * k + n][:6] for v in by_source.values()]
            table = state.advance(table, spark.createDataFrame(step, results.schema), es.KEYS)
        table = spark.createDataFrame(table.collect(), table.schema)
    final = {(r["edition_id"], r["source_id"]): (r["observed_hash"], r["success_hash"], r["fetch_status"]) for r in table.collect()}
    assert final == {k: states[(*k, v[-1][2])][:3] for k, v in by_source.items()}
