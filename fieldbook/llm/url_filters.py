"""URL filters: explicit host/path rules, then host word segmentation with multinomial naive Bayes.

* Unigram model: words of the visible text of every page, of any length, counted over all rows, split concatenated host labels
  and path parts by Viterbi. The counts stay a table: rows are dealt into parts of bounded size, the distinct substrings of a
  part's letter runs (of the lengths that words have) are joined with all counts, and each part splits its runs with the words
  that it found.
* Naive Bayes: the pages that a rule decides are its labelled rows (block or allow), all of them; nothing else is known
  beforehand, and both classes count the same. Tokens are hashed into ``BUCKETS`` counters, so the model has a fixed size.

Defined results: every row gives one row; a null url or one without ``://`` has empty host and path, no rule and no tokens, and
is allowed (score 0), as is one of whose tokens no ruled url has any; equal urls get equal verdicts; without labelled pages every url has score 0
and is allowed; null html has no words; very long urls and pages are read whole; a null page_id comes back null; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

# fixed values: (action, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SUBSTRINGS = 100_000  # held at once before they are sent on
#: Count that every seen bucket has in each class beforehand.
SMOOTHING = 0.1
BUCKETS = 1 << 18
PART_ROWS = 20_000
LETTERS = regex.compile(r"\p{L}+")
RUNS = regex.compile(r"\p{L}+|\p{Nd}+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``; both empty for null or where ``://`` is missing."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at == 0, F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest fitting rule, null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    rule = F.coalesce(*[F.when(c, F.lit(h + p)) for c, (_, h, p) in zip(fits, ordered)])
    action = F.coalesce(*[F.when(c, F.lit(a)) for c, (a, _, _) in zip(fits, ordered)])
    return rule, action


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(word, n)`` of lower-case words in the visible text of all pages."""
    visible = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z]+;", " ")
    rows = pages.select(F.explode(F.split(F.lower(visible), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return rows.groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Unigram Viterbi over a dictionary of log probabilities.

    ``total`` counts all words and ``lengths`` are the lengths they have, if ``counts`` holds only some of them.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, lengths: list[int] | None = None):
        total = total or sum(counts.values()) or 1
        self.logp = {w: math.log(n / total) for w, n in counts.items()}
        self.lengths = sorted(set(map(len, counts)) if lengths is None else lengths, reverse=True)
        rare = math.log(1.0 / total) - 1.0
        self.open, self.more = rare, 0.7 * rare  # an unknown stretch: a price to open it, and one for each character
        self.seen: dict[str, tuple[str, ...]] = {}

    def split(self, text: str) -> tuple[str, ...]:
        """The likeliest split; unknown stretches cost more with every character. Ties: the longer last word."""
        if text in self.seen:
            return self.seen[text]
        # best[i]: of the first i characters; stretch: of those that end in an unknown stretch, and where that begins
        best, back = [0.0], [0]
        stretch, begin = -math.inf, 0
        for end in range(1, len(text) + 1):
            stretch += self.more
            fresh = best[end - 1] + self.open + self.more
            if fresh > stretch:
                stretch, begin = fresh, end - 1
            top, cut = -math.inf, 0
            for n in self.lengths:
                if n <= end and (p := self.logp.get(text[end - n : end])) is not None and best[end - n] + p > top:
                    top, cut = best[end - n] + p, end - n
            if stretch > top:
                top, cut = stretch, begin
            best.append(top)
            back.append(cut)
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        found = tuple(reversed(out))
        if len(self.seen) >= 100_000:
            self.seen.clear()
        self.seen[text] = found
        return found

    def tokens(self, host: str, path: str) -> list[str]:
        """Tokens of host labels (``h:``) and path parts (``p:``); digits become one token."""
        out = []
        for kind, text in (("h:", host.lower()), ("p:", path.lower())):
            for run in RUNS.findall(text):
                out += [kind + w for w in self.split(run)] if LETTERS.match(run) else [kind + "<num>"]
        return out


def _bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token) & (BUCKETS - 1)


def with_tokens(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``tokens`` of ``host`` and ``path``, split with all word counts."""
    parts = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // PART_ROWS))
    # rows are numbered once and written, so that both sides below see the same parts, of equal size whatever the rows hold
    dealt = materialize(rows.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")), "dealt")
    found = counts.groupBy(F.length("word").alias("l")).agg(F.sum("n").alias("n")).collect()  # a row for each length that words have
    total, lengths = sum(r["n"] for r in found), sorted(r["l"] for r in found)

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, found = set(), set()
            for k, *texts in zip(*(batch.column(c).to_pylist() for c in ("_part", "host", "path"))):
                runs.update((k, r) for t in texts for r in LETTERS.findall(t.lower()))
            for k, run in runs:
                for n in lengths:
                    found.update((k, run[at : at + n]) for at in range(len(run) - n + 1))
                    if len(found) >= SUBSTRINGS:
                        yield batch_of(found)
                        found.clear()
            if found:
                yield batch_of(found)

    def batch_of(found: set[tuple[int, str]]) -> pa.RecordBatch:
        at, words = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words)], ["_part", "word"])

    def split(own: pa.Table, known: pa.Table) -> pa.Table:
        segmenter = Segmenter(dict(zip(known.column("word").to_pylist(), known.column("n").to_pylist())), total, lengths)
        tokens = [segmenter.tokens(h, p) for h, p in zip(own.column("host").to_pylist(), own.column("path").to_pylist())]
        return own.drop_columns(["_part"]).append_column("tokens", pa.array(tokens, pa.list_(pa.string())))

    known = dealt.select("_part", "host", "path").mapInArrow(substrings, "_part int, word string").distinct().join(counts, "word")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    full = F.expr("host <> '' or path <> ''")
    return dealt.where(full).groupBy("_part").cogroup(known.groupBy("_part")).applyInArrow(split, f"{schema}, tokens array<string>").unionByName(
        dealt.where(~full).drop("_part").withColumn("tokens", F.array().cast("array<string>"))
    )


def learn(ruled: DataFrame, balanced: bool = True) -> tuple[np.ndarray, float]:
    """``(log2 odds of each bucket, log2 odds of the prior)`` block against allow, from all rows with ``tokens`` and an ``action``.

    Counts are smoothed over the buckets that were seen; a bucket that no ruled url has says nothing. Rules decide far more urls one way
    than the other, which says nothing about the rest, so the classes count the same unless ``balanced`` is false.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {"block": np.zeros(BUCKETS, np.int64), "allow": np.zeros(BUCKETS, np.int64)}
        rows = dict.fromkeys(totals, 0)
        for batch in batches:
            for tokens, a in zip(*(batch.column(c).to_pylist() for c in ("tokens", "action"))):
                rows[a] += 1
                for t in tokens:
                    totals[a][_bucket(t)] += 1
        for a, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"action": pa.array([a] * (len(at) + 1)), "bucket": pa.array([*at, -1], pa.int32()), "n": pa.array([*counts[at], rows[a]], pa.int64())})

    labelled = ruled.where("action is not null").select("tokens", "action").mapInArrow(count, "action string, bucket int, n bigint")
    found = labelled.groupBy("action", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * (BUCKETS + 1) rows
    block = np.array(found.column("action").to_pylist(), object) == "block"
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    seen = np.bincount(bucket[bucket >= 0], minlength=BUCKETS) > 0
    logs, prior = [], []
    for mine in (block, ~block):
        c = np.bincount(bucket[mine & (bucket >= 0)], weights=n[mine & (bucket >= 0)], minlength=BUCKETS).astype(float)
        logs.append(np.log2((c + SMOOTHING) / (c.sum() + SMOOTHING * max(1, int(seen.sum())))))
        prior.append(1 + int(n[mine & (bucket < 0)].sum()))
    return np.where(seen, logs[0] - logs[1], 0.0), 0.0 if balanced else math.log2(prior[0] / prior[1])


def tokenized(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, action, tokens`` of every row, written."""
    words = materialize(word_counts(pages), "words")
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = match_rules(F.col("host"), F.col("path"), rules)
    return materialize(with_tokens(parsed.select("page_id", "host", "path", rule.alias("rule"), action.alias("action")), words), "tokens")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, host_words, block_score``."""
    ruled = tokenized(pages, rules)
    return scored(ruled, *learn(ruled))


def scored(ruled: DataFrame, odds: np.ndarray, prior: float) -> DataFrame:
    """Verdicts of tokenized rows by a model of :func:`learn`."""
    spark = ruled.sparkSession
    model = spark.sparkContext.broadcast((odds, prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, base = model.value
        for batch in batches:
            hosts, scores = [], []
            for tokens in batch.column("tokens").to_pylist():
                hosts.append(" ".join(t[2:] for t in tokens if t[0] == "h"))
                scores.append(base + float(sum(ratio[_bucket(t)] for t in tokens)))
            verdict = [a or ("block" if s > 0 else "allow") for a, s in zip(batch.column("action").to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict), pa.array(hosts), pa.array(scores, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "host_words", "block_score"],
            )

    id_type = ruled.schema["page_id"].dataType.simpleString()
    return ruled.mapInArrow(score, f"page_id {id_type}, host string, path string, rule string, verdict string, host_words string, block_score double")
