"""Language identification: blended-spectrum n-gram presence kernel, Nyström landmarks, kernel ridge regression.

Kernel: ``k(x, y) = |A & B| / sqrt(|A| |B|)`` over the sets of byte n-grams of lengths 1 to 4 of the whole
lower-cased texts, hashed into a fixed number of cells. At most ``PER_LANG`` learning rows of each language (smallest hashes of id
and text; the documented bound of the fit) give packed presence rows, of which ``LANDMARKS`` span the Nyström space; one ridge
regression per language is solved on the driver. Every text is then scored by one matrix product with the landmarks and one with
the coefficients, a batch at a time.

The learning rows are found without sorting any language: rows are counted by language, those whose hash lies below a share that
should leave twice as many as wanted are packed, repeated rows meet in partial aggregates, and the share grows until it has enough.

Defined results: every row gives one row, also where ids repeat; null, empty and blank texts and texts without a letter give ``und``
and score 0; so does every text if nothing can be learned; ties go to the alphabetically first language; rows without a text or a
language teach nothing; a null id counts as the empty string in the fold rule and comes back null; rows that agree in id and text teach
once; a very long text is read whole (its n-grams are a set, whatever its length); an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import slices

CELL_BITS = 15
CELLS = 1 << CELL_BITS
LENGTHS = (1, 2, 3, 4)
PER_LANG = 500
LANDMARKS = 192
RIDGE = 1e-2
ROWS = 256


def id_crc(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def presence(texts: pa.Array) -> np.ndarray:
    """``rows x CELLS`` booleans: which hashed n-grams each whole text holds."""
    low = pc.cast(pc.utf8_lower(pc.fill_null(texts, "")), pa.binary())
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if low.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(low), dtype=np.int64) * CELLS, size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes up to the end of the text
    x = np.zeros(len(low) * CELLS, bool)
    code = data.astype(np.uint32)
    base = code
    for n in LENGTHS:
        if n > 1:
            if len(data) < n:
                break
            code = (code[:-1] << np.uint32(8)) | base[n - 1 :]
        with np.errstate(over="ignore"):
            h = ((code + np.uint32(n)) * np.uint32(2654435761)) ^ (code >> np.uint32(15))
            h = (h * np.uint32(2246822519)) >> np.uint32(32 - CELL_BITS)
        at = row[: len(h)] + h
        x[at[left[: len(h)] >= n]] = True
    return x.reshape(len(low), CELLS)


def kernel(x: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Normalised kernel of presence rows with the landmarks."""
    own = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
    return (x.astype(np.float32) @ landmarks) / own[:, None] / norms[None, :]


def fit(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """The model: landmark matrix, its norms, coefficients of each language's regression in kernel space."""
    names = sorted(set(langs))
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    by_lang = {n: [i for i, lang in enumerate(langs) if lang == n] for n in names}
    picks, k = [], 0
    while len(picks) < min(landmarks, len(langs)):  # round robin over the languages
        picks += [rows[k] for rows in by_lang.values() if k < len(rows)]
        k += 1
    land = x[picks].astype(np.float32).T.copy()
    norms = np.sqrt(np.maximum(land.sum(axis=0), 1)).astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(x[picks], land, norms).astype(np.float64))
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])  # K_mm ** -1/2
    phi = np.concatenate([kernel(x[a : a + ROWS], land, norms) for a in range(0, len(x), ROWS)]).astype(np.float64) @ half
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    balance = 1.0 / (len(names) * np.array([len(by_lang[lang]) for lang in langs]))  # every language weighs the same
    gram = (phi * balance[:, None]).T @ phi + ridge / len(phi) * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, (phi * balance[:, None]).T @ y)
    return {"names": names, "land": land, "norms": norms, "coef": (half @ w[:-1]).astype(np.float32), "bias": w[-1].astype(np.float32)}


def predict(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """``(language, score)`` of each text; score is the winner's regression value mapped to 0..1."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False).astype(bool)
    if not model["names"]:
        return ["und"] * len(texts), np.zeros(len(texts))
    out = kernel(presence(texts), model["land"], model["norms"]) @ model["coef"] + model["bias"]
    best = out.argmax(axis=1)
    score = np.where(letters, np.clip((out[np.arange(len(out)), best] + 1) / 2, 0, 1), 0.0)
    return [model["names"][b] if ok else "und" for b, ok in zip(best, letters)], score.astype(float)


def _rank() -> Column:
    """A place in [0, 1) from the hash of id and text."""
    return F.pmod(F.xxhash64(F.col("id").cast("string"), "tag"), F.lit(1 << 40)) / float(1 << 40)


def learning_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """``lang, rank, id, tag, bits``: of each language the ``per_lang`` rows of smallest rank, with their packed n-gram presence."""
    text = F.col(text_col)
    known = docs.where(text.isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    size = known.groupBy("lang").agg(F.count("*").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                for at in range(0, len(cut), ROWS):
                    part = cut.slice(at, ROWS)
                    bits = np.packbits(presence(part.column("text")), axis=1)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "rank", "id", "tag")), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "rank", "id", "tag", "bits"])

    sizes = {r["lang"]: r["n"] for r in size.collect()}  # a row for each language: the model has a regression for each anyway
    share = {lang: 2.0 * per_lang / n for lang, n in sizes.items()}
    found = None
    while share:  # once, unless many rows of a language repeat
        upto = docs.sparkSession.createDataFrame(list(share.items()), "lang string, upto double")
        # a row for each language, which the driver holds anyway: no text is shuffled
        picked = known.withColumn("rank", _rank()).join(F.broadcast(upto), "lang").where("rank < upto").select("lang", "rank", "id", "tag", "text")
        rows = picked.mapInArrow(pack, "lang string, rank double, id string, tag bigint, bits binary")
        rows = materialize(rows.groupBy("lang", "rank", "id", "tag").agg(F.first("bits").alias("bits")), "learning")
        found = rows if found is None else found.join(upto, "lang", "left_anti").unionByName(rows)
        got = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
        share = {lang: 8 * s for lang, s in share.items() if s < 1 and got.get(lang, 0) < per_lang}
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank double, id string, tag bigint, bits binary")
    w = Window.partitionBy("lang").orderBy("rank", "id", "tag")  # over about twice the rows that stay
    return found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_lang).drop("_rn")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> dict:
    """Learns from rows with text and language; only packed presence rows of the bounded sample reach the driver."""
    got = sorted(learning_rows(docs, id_col, text_col, lang_col, per_lang).collect(), key=lambda r: (r["lang"], r["rank"], r["id"] or "", r["tag"]))
    if not got:
        return {"names": []}
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(bool)
    return fit(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row; only the text is read for a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                for at in range(0, len(cut), ROWS):
                    part = cut.slice(at, ROWS)
                    lang, value = predict(shared.value, part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang), pa.array(value, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
