"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import sets
from fieldbook.operators import state as st
from fieldbook.sources import readers, writers
from fieldbook.streaming import state as stream


def test_envelope_and_fallback(spark, tmp_path):
    p = tmp_path / "env.json"
    p.write_text(json.dumps({"schemaVersion": "1", "generatedAt": "x", "records": [{"id": "a"}, {"id": "b"}]}))
    assert readers.json_envelope(spark, str(p), "id:string", "1").count() == 2
    with pytest.raises(Exception, match="schemaVersion"):
        readers.json_envelope(spark, str(p), "id:string", "2").collect()
    empty = readers.or_empty(spark, str(tmp_path / "none"), "id string", lambda s, x: s.read.parquet(x))
    assert empty.count() == 0
    assert readers.first_non_empty(empty, readers.json_envelope(spark, str(p), "id:string")).count() == 2


def test_failed_source_is_skipped(spark, tmp_path):
    good = lambda: spark.createDataFrame([("a",)], "id string")

    def bad():
        raise OSError("down")

    (tmp_path / "broken.json").write_text('[{"id": "x"}, {"id": ')
    broken = lambda: readers.json_array(spark, str(tmp_path / "broken.json"), "id string")  # noqa: E731  fails in a task only
    got, errors = readers.run_sources({"good": good, "bad": bad, "broken": broken}, "id string", spark, str(tmp_path / "landing"))
    assert got.count() == 1 and errors["bad"] == "down" and set(errors) == {"bad", "broken"}


def test_connector_outputs(spark, tmp_path):
    for k in "ab":
        (tmp_path / f"{k}.json").write_text(json.dumps({"generatedAt": "x", "records": [{"id": k}, {"id": k + "2"}]}))
    got = readers.connector_outputs(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "id:string")
    assert {r["id"] for r in got.collect()} == {"a", "a2", "b", "b2"}


def test_write_or_restore(spark, tmp_path):
    path, one, two = str(tmp_path / "t"), spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    value = lambda: [r[0] for r in spark.read.parquet(path).collect()]

    def fail():
        raise RuntimeError("next step")

    with pytest.raises(RuntimeError):
        writers.write_or_restore(one, path, fail)
    assert not (tmp_path / "t").exists()
    writers.write_or_restore(one, path, lambda: None)
    with pytest.raises(RuntimeError):
        writers.write_or_restore(two, path, fail)
    assert value() == [1]
    writers.write_or_restore(two, path, lambda: None)
    assert value() == [2] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>A</p>\n<script>x</script><p>B</p>")
    (tmp_path / "b.txt").write_text(" x  y \n\n z")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "A B", "b.txt": "x y\nz"}


def test_validated_write(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "a int")
    writers.write_validated(df, path, lambda x: x.count() == 1)
    with pytest.raises(ValueError, match="validation"):
        writers.write_validated(df.union(df), path, lambda x: x.count() == 1)
    assert spark.read.parquet(path).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    two = str(tmp_path / "u")
    writers.write_in_order((df, path), (df, two), "a", df)
    with pytest.raises(ValueError, match="validation"):
        writers.write_in_order((df, path), (df, two), "a", spark.createDataFrame([(2,)], "a int"))


def test_manifest(spark):
    a = spark.createDataFrame([("p1", "x"), ("p2", "y")], "p string, b string")
    h = lambda d: sets.manifest_hash(d, "p", F.col("b")).first()["hash"]
    assert h(a) == h(a.orderBy(F.desc("p"))) != h(a.withColumn("b", F.lit("z")))


def test_meaningful_changes(spark):
    cols = "id int, v string, at string"
    a = spark.createDataFrame([(1, "x", "t1"), (2, "x", "t1"), (3, "x", "t1"), (4, None, "t1")], cols)
    b = spark.createDataFrame([(1, "x", "t1"), (2, "x", "t2"), (3, "y", "t2"), (5, "x", "t1")], cols)
    got = {r["id"]: r["change"] for r in sets.meaningful_changes(a, b, "id", ["at"]).collect()}
    assert got == {2: "volatile_only", 3: "changed", 4: "removed", 5: "added"}
    h = lambda df: sets.manifest_hash(df, "id", sets.stable_body(df, ["at"])).first()["hash"]
    assert h(a) == h(a.withColumn("at", F.lit("later"))) != h(b)


PHRASES = [(1, "b c d e f"), (2, "b c"), (3, "c"), (4, "a b c"), (5, "tail of a phrase"), (6, ""), (7, "b  c d e f"), (8, "x y"), (9, "one two"), (10, "a b c d e f g")]


def test_phrases_against_contains(spark):
    """Words cut at the ends of a phrase, phrases of one word, repeated and null ids, null texts."""
    texts = [(1, "a b c d e f g"), (1, "ab c d e fg"), (2, "retail of a phrases"), (None, "b  c d e f"), (None, "xx yy"), (3, None), (4, ""), (5, "a b c d e f g"), (5, "a b c d e f g")]
    df, ph = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(PHRASES, "pid int, p string")
    want = sorted(((i, k) for i, t in texts for k, p in PHRASES if t and p and p in t), key=repr)
    assert sorted((tuple(r) for r in sets.contains_pairs(df, "id", "t", ph, "pid", "p").collect()), key=repr) == want
    first = sorted(((i, min([k for k, p in PHRASES if t and p and p in t], default=None)) for i, t in texts), key=repr)
    assert sorted((tuple(r) for r in sets.first_containing(df, "id", "t", ph, "pid", "p", "f").select("id", "f").collect()), key=repr) == first
    assert sets.contains_pairs(df, "id", "t", ph.where("false"), "pid", "p").count() == 0


def test_nearest_others(spark):
    import random

    from fieldbook.operators import rank

    rng = random.Random(4)
    rows = [(i, rng.randrange(3), float(rng.randrange(6))) for i in range(60)] + [(100, 9, 1.0), (101, 8, 2.0), (102, 8, 2.0)]
    got = {(r["left_id"], r["rank"]): r["right_id"] for r in rank.nearest_others(spark.createDataFrame(rows, "id int, g int, v double"), "g", "v", "id").collect()}
    want = {}
    for i, g, v in rows:
        near = sorted((abs(v - w), j) for j, h, w in rows if h == g and j != i)[:3]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(near)}
    assert got == want


def test_confidence_and_names(spark):
    from fieldbook.operators import merge

    df = spark.createDataFrame([("a", 0.7), ("a", 0.75), ("b", 0.9)], "k string, c double")
    got = {r["k"]: (r["confidence"], r["seed_confidence"]) for r in merge.average_confidence(df, ["k"], "c").collect()}
    assert got["a"][0] in (0.72, 0.73) and got["a"][1] == round(got["a"][0] + 0.06, 2) and got["b"] == (0.9, 0.9)
    assert spark.range(1).select(merge.argmax_name({"x": F.lit(1), "y": F.lit(5), "z": F.lit(5)})).first()[0] == "y"


def test_stream_matches_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "ts", "event_id")
    src = str(tmp_path / "in")
    e.repartition(5).write.parquet(src)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(src)
    stream.upsert_stream(s, str(tmp_path / "store"), str(tmp_path / "ck"), ["user_id", "event_type"], ["ts", "event_id"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "store"))
    want = st.latest(e, ["user_id", "event_type"], ["ts", "event_id"])
    assert not list(tmp_path.glob("store.batch-*")) and got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()


def test_stream_exposures(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    e.write.parquet(src)
    s = stream.exposures(spark.readStream.schema(e.schema).parquet(src), ["user_id", "event_type"], "value", "ts", "60 days")
    q = s.writeStream.format("memory").queryName("exposed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("exposed").count() == e.where("value >= 0.25").select("user_id", "event_type").distinct().count()
