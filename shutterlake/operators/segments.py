"""Words of texts that are written without spaces: the best path through the graph of all words that a dictionary finds.

The dictionary (word, n) is counted by Spark, of bounded size, and goes to the tasks as the sorted hashes of ``dictionary.Terms``. All
its words in a batch of texts are found at once; each is an edge of its text's graph, weighted by the logarithm of its share, and
each character is an edge of least weight. Texts fall into pieces at the places that lie in no edge. The best sum over the edges up
to each place is found for all pieces of the batch side by side, place by place, over all lengths of word as one small matrix; of
equal sums the longer last word counts. Weights are whole
numbers, so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.batches import characters, parts, texts_of, utf8
from shutterlake.operators.dictionary import Terms
from shutterlake.sources.shared import dealt

#: Words of a dictionary at most, and the longest of them, in bytes.
MOST_WORDS, LONGEST = 200_000, 48
#: Weights are in these parts of a bit.
SCALE = 1 << 20
_NONE = -(1 << 30)
#: What parts fields that have no Chinese, and what runs texts that have are cut into.
DELIMITERS = r"[\s\x{3000},.;:!?、，。；：！？/\\|'\"()\[\]{}]+"
RUNS = "[㐀-鿿]+|[a-zA-Z0-9]+"
CHINESE = "[㐀-鿿]"


def words_counted(docs: DataFrame, column: str = "text", least: int = 2, most: int = MOST_WORDS) -> DataFrame:
    """(word, n): words of the texts, split at ``DELIMITERS``, ASCII in lower case, that occur ``least`` times, the ``most`` frequent."""
    each = dealt(docs.select(column)).select(F.explode(delimited(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return each.where((F.col("n") >= least) & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(most)


def delimited(text: Column) -> Column:
    """Tokens between delimiters; ASCII ones in lower case."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), DELIMITERS, -1), lambda t: t != "")
    return F.transform(own, lambda t: F.when(t.rlike(r"^[\x00-\x7F]+$"), F.lower(t)).otherwise(t))


class Graph:
    """A dictionary's words and weights."""

    def __init__(self, words: list[str], counts: list[int]):
        self.terms = Terms([("", w) for w in words])
        of = dict(zip(words, counts, strict=True))
        total = max(sum(counts), 1)
        self.weight = np.array([round(np.log2(of[w] / total) * SCALE) for w in self.terms.terms], np.int64)
        #: a character that is no word weighs less than a word that occurs once
        self.unknown = round(np.log2(0.5 / total) * SCALE)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(start, end) of the words of all texts in order, and those of all dictionary words found, chosen or not."""
        n = len(data)
        start, end, term = self.terms.hits(data, offsets)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(begins[1:], n)
        sizes = np.unique(np.concatenate([end - start, ends - begins])) if n else np.zeros(0, np.int64)
        weight = np.full((n + 1, len(sizes)), _NONE, np.int32)
        weight[ends, np.searchsorted(sizes, ends - begins)] = self.unknown
        weight[end, np.searchsorted(sizes, end - start)] = self.weight[term]
        # no path passes a place that lies in no edge without stopping there, so texts fall into pieces that are cut each by itself
        inside = np.zeros(n + 2, np.int32)
        for a, b in ((start, end), (begins, ends)):
            inside += np.bincount(a + 1, minlength=n + 2)[: n + 2] - np.bincount(b, minlength=n + 2)[: n + 2]
        piece = np.flatnonzero(np.cumsum(inside)[:n] == 0)
        last = np.append(piece[1:], n) if n else piece
        stops = np.zeros(n + 1, bool)
        stops[last] = True
        wide = last > ends[np.searchsorted(begins, piece)]  # a character alone is cut already
        piece, last = piece[wide], last[wide]
        best = np.full(n + 1, np.iinfo(np.int64).min // 4)
        choice = np.zeros(n + 1, np.int64)
        lanes = np.argsort(piece - last, kind="stable")
        first, length = piece[lanes], (last - piece)[lanes]
        for t in range(1, int(length.max(initial=0)) + 1):
            live = first[: np.searchsorted(-length, -t, side="right")]
            at, some = live + t, np.searchsorted(sizes, t, side="right")
            back = sizes[:some][::-1]  # longer words first, so that they win ties
            from_ = at[:, None] - back[None, :]
            sums = np.where(from_ == live[:, None], 0, best[from_]) + weight[at, :some][:, ::-1]
            if some:
                k = np.argmax(sums, axis=1)
                best[at], choice[at] = sums[np.arange(len(at)), k], back[k]
        at, low = last, piece
        while len(at):  # all pieces step back a word at a time
            stops[at] = True
            at = at - choice[at]
            low, at = low[at > low], at[at > low]
        stop = np.flatnonzero(stops)
        # a text's last byte ends a word, so words tile the batch
        return np.append(0, stop[:-1]) if len(stop) else stop, stop, (start, end)


def segmented(texts: DataFrame, words: DataFrame, column: str = "text", search: bool = False) -> DataFrame:
    """``texts`` with ``words``: the best cut of ``column`` into words of ``words`` (word, n) and single characters; null is empty.

    With ``search``, a word of more than two characters comes after the dictionary's words of two and of three characters in it.
    """
    got = words.select("word", F.col("n").cast("bigint").alias("n")).where("word <> '' AND n > 0").groupBy("word").agg(F.max("n").alias("n")).limit(MOST_WORDS + 1).toArrow()
    if got.num_rows > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    sent = texts.sparkSession.sparkContext.broadcast(Graph(got.column("word").to_pylist(), got.column("n").to_pylist()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, column, 1 << 19):
                data, offsets = utf8(batch.column(column))
                start, end, every = sent.value.cut(data, offsets)
                if search and len(start):
                    start, end = _with_parts(start, end, *every, characters(data))
                text = np.searchsorted(offsets, start, side="right") - 1
                size = end - start
                letters = data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
                first = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(first), texts_of(letters, np.append(0, np.cumsum(size))))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "words"])

    return texts.mapInArrow(task, ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", words array<string>")


def _with_parts(start: np.ndarray, end: np.ndarray, found: np.ndarray, stop: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen words, each after the shorter ones of two characters, then of three, that it holds."""
    size = before[end] - before[start]
    inside = np.searchsorted(start, found, side="right") - 1
    short = before[stop] - before[found]
    keep = (stop <= end[inside]) & (short >= 2) & (short <= 3) & (short < size[inside])
    found, stop, inside, short = found[keep], stop[keep], inside[keep], short[keep]
    s, e = np.concatenate([found, start]), np.concatenate([stop, end])
    order = np.lexsort((s, np.concatenate([short, np.full(len(start), 9)]), np.concatenate([inside, np.arange(len(start))])))
    return s[order], e[order]


def search_words(texts: DataFrame, words: DataFrame, column: str = "text", stops: list[str] | None = None) -> DataFrame:
    """(the columns of ``texts``, ``tokens``): words to search by. A text without Chinese is cut at delimiters; one with it into runs of
    Chinese, segmented for search, and runs of ASCII letters and figures, in lower case. ``stops`` are left out; rows keep their order
    of tokens, and each token's first place."""
    key = "__row"
    own = texts.withColumn(key, F.monotonically_increasing_id())
    runs = own.where(F.col(column).rlike(CHINESE)).select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(RUNS), F.lit(0))).alias("at", "run"))
    chinese = segmented(runs.where(F.col("run").rlike(CHINESE)), words, "run", search=True).select(key, "at", "words")
    latin = runs.where(~F.col("run").rlike(CHINESE)).select(key, "at", F.array(F.lower("run")).alias("words"))
    cut = chinese.unionByName(latin).groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda r: r["words"])).alias("__cut"))
    tokens = F.coalesce("__cut", delimited(F.col(column)))
    left = F.filter(F.array_distinct(tokens), lambda t: ~t.isin(stops)) if stops else F.array_distinct(tokens)
    return own.join(cut, key, "left").select(*texts.columns, left.alias("tokens"))
