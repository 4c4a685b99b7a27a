r"""How far the sources of a language differ in their words: exact integer divergences between sources, and their telling terms.

Terms are runs of letters and other characters beyond ASCII, of ASCII only A-Z lower-cased. Tasks find the terms of a batch as
one Arrow dictionary and send a count for each (language, source, term); Spark adds these up. Of each language the terms of
LEAST_DOCS documents stay. Their rows are dealt by ranges of (language, term) and sorted, so each task cuts its rows into chunks
of a sorted array of kept terms: a term's id is its place there (``searchsorted``), one ``bincount`` makes the dense counts of
all sources of the language, and ids are in the order of UTF-8, which is the order of ties. A chunk gives a partial sum for each
two sources and the first TOP terms of each source; Spark adds up and ranks.

Numbers are integers throughout: p = 1 + floor(SCALE * (count + 1) / (N + V)) comes by long division in steps of 1,000, right
for up to 9e15 occurrences of a language. All sources of a language are in the result in pairs, so their number is bounded by
what a result can hold: one number for each (language, source) is sent to the tasks, of MOST_GROUPS at the most, beyond which
an error says so. A chunk has as many terms as keep the dense counts near CELLS numbers, whatever the vocabulary.

Defined results: a null text, language or source counts as ''; rows repeated are documents of their own, with or without ids; a
source without terms still has its pairs; a language without kept terms has pairs of value 0; an empty table gives no rows;
ties go by the item's UTF-8; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import slices, utf8, written

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
MOST_GROUPS = 1_000_000
CELLS = 1 << 21
SLICE = 8 << 20
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text of each term, and the terms."""
    data, at = utf8(texts)
    own, begins = _TERM[data], np.zeros(len(data) + 1, bool)
    begins[at] = True
    starts = np.flatnonzero(own & (np.concatenate([[True], ~own[:-1]]) | begins[:-1])) if len(data) else np.zeros(0, np.int64)
    letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])  # before each byte
    offsets = np.append(letters[starts], letters[-1])
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[own]])])
    return np.searchsorted(at, starts, side="right") - 1, found


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that have it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE, rows=1 << 16):
            row, found = terms(batch.column("text"))
            if not len(found):
                continue
            coded = found.dictionary_encode()
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            # (group, term, document) as one number: group and document are below 2 ** 16, terms below 2 ** 23
            group_of, groups = np.unique(group, return_inverse=True)
            key = np.sort((groups[row] * len(words) + code) * batch.num_rows + row)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            cell = key // batch.num_rows
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            n = np.diff(np.append(first, len(key)))
            in_docs = np.diff(np.append(np.searchsorted(new, first), len(new)))
            of_group, of_term = group_of[cell[first] // len(words)], cell[first] % len(words)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(of_group // len(sources.dictionary))), sources.dictionary.take(pa.array(of_group % len(sources.dictionary))),
                 words.take(pa.array(of_term)).cast(pa.string()), pa.array(n), pa.array(in_docs)], names=["lang", "source", "term", "n", "docs"])

    sent = docs.mapInArrow(task, "lang string, source string, term string, n bigint, docs bigint")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lead) of the terms that ``least`` documents of their language have; lead: once for each (lang, term).
    A row is made of a term's sources before they part again, so whether it stays is known without a join."""
    every = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("own")).where(F.col("docs") >= least)
    each = every.select("lang", "term", F.posexplode("own").alias("at", "own"))
    return each.select("lang", F.col("own.source").alias("source"), "term", F.col("own.n").alias("n"), (F.col("at") == 0).alias("lead"))


def probabilities(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact."""
    q, r = np.divmod(count.astype(np.int64) + 1, total)
    for _ in range(3):  # SCALE is 1,000 ** 3
        d, r = np.divmod(r * 1_000, total)
        q = q * 1_000 + d
    return q + 1


class Language:
    """The sources of a language in UTF-8 order, with N + V of each and of the language as a whole."""

    def __init__(self, sources: list[str], n: list[int], vocabulary: int):
        order = sorted(range(len(sources)), key=lambda i: sources[i].encode())
        self.names = np.array([sources[i].encode() for i in order], object)
        counts = np.array([n[i] for i in order], np.int64)
        self.vocabulary, self.totals, self.total = vocabulary, counts + vocabulary, int(counts.sum()) + vocabulary

    def width(self) -> int:
        return max(16, CELLS // len(self.names))


def chunk(language: Language, source: np.ndarray, term: np.ndarray, n: np.ndarray, top: int = TOP) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(source, part, item ids or terms, values) from whole terms' rows: partial sums by pair of sources, and a source's first terms."""
    words = term[np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))]  # sorted rows: the sorted array of kept terms
    ids, s, v = np.searchsorted(words, term), len(language.names), len(words)
    counts = np.bincount(np.searchsorted(language.names, source) * v + ids, n, minlength=s * v).astype(np.int64).reshape(s, v)
    p = probabilities(counts, language.totals[:, None])
    q = probabilities(counts.sum(axis=0), np.int64(language.total))
    out = []
    for i in range(s):
        d = p[i] - p
        out.append((i, "pair", np.arange(s), (d * d // p).sum(axis=1)))
        more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        f = (p[i, more] - q[more]) ** 2 // q[more]
        best = np.argsort(-f, kind="stable")[:top]  # ids rise, so ties are in order
        out.append((i, "term", words[more[best]], f[best]))
    return out


def _languages(docs: DataFrame, rows: DataFrame) -> dict[str, Language]:
    """By language; from a row for each (lang, source)."""
    groups = docs.select("lang", "source").distinct()
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("lead").alias("lead"))
    got = groups.join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lead", F.lit(0)).alias("lead")).limit(MOST_GROUPS + 1).toArrow()
    if got.num_rows > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} sources of languages: their pairs are the result")
    out: dict[str, list] = {}
    for lang, source, n, lead in zip(*(got.column(c).to_pylist() for c in ("lang", "source", "n", "lead")), strict=True):
        out.setdefault(lang, []).append((source, n, lead))
    return {k: Language([x[0] for x in v], [x[1] for x in v], sum(x[2] for x in v)) for k, v in out.items()}


def audited(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    rows = written(kept(counted(docs), least))
    languages = _languages(docs, rows)
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def batch_of(lang: str, source: np.ndarray | list, part: str, items: list, values: np.ndarray) -> pa.RecordBatch:
        cast = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), cast(source), pa.array([part] * n, pa.string()), cast(items), pa.array(values)], names=["lang", "source", "part", "item", "value"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(lang: str, parts: list) -> Iterator[pa.RecordBatch]:
            language = sent.value[lang]
            columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
            for i, part, items, values in chunk(language, *columns, top):
                if part == "pair":
                    others = items != i
                    items, values = language.names[items[others]], values[others]
                if len(values):
                    yield batch_of(lang, [language.names[i]] * len(values), part, list(items), values)

        lang, parts, width, last = None, [], 0, None
        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            term = np.array(batch.column("term").cast(pa.binary()).to_pylist(), object)
            source = np.array(batch.column("source").cast(pa.binary()).to_pylist(), object)
            n = batch.column("n").to_numpy()
            if not len(term):
                continue
            new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (langs[1:] != langs[:-1])]))
            for a, b in zip(new, np.append(new[1:], len(term)), strict=True):
                if parts and (langs[a] != lang or (width >= sent.value[lang].width() and term[a] != last)):
                    yield from done(lang, parts)
                    parts, width = [], 0
                width += term[a] != last or langs[a] != lang
                lang, last = langs[a], term[a]
                parts.append((source[a:b], term[a:b], n[a:b]))
        if parts:
            yield from done(lang, parts)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the languages that keep no term."""
        for batch in batches:
            for lang, source in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                language = sent.value[lang]
                others = [x for x in language.names if x != source.encode()]
                if not language.vocabulary and others:
                    yield batch_of(lang, [source.encode()] * len(others), "pair", others, np.zeros(len(others), np.int64))

    kind = "lang string, source string, part string, item string, value bigint"
    ranged = rows.select("lang", "term", "source", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    found = written(ranged.mapInArrow(task, kind))
    pairs = found.where("part = 'pair'").unionByName(docs.select("lang", "source").distinct().mapInArrow(alone, kind))
    pairs = pairs.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS p,
  1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.n + l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM l)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
