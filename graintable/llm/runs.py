"""Periodic runs of words: where a text says the same words over and over.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping that period. Suffix trees of the words and of
their reversal are built with Ukkonen's algorithm; an Euler tour of a tree, with a table of minima over powers of two, gives the lowest common
ancestor of two leaves, and so the longest common extension of two positions, in constant time. Every run holds a Lyndon
word that is the longest one at its start, in one of two orders of the words: so each position gives two candidates (the next smaller suffix ends
the word), which are extended both ways by the two trees. Candidates are at most two for each word, whatever the text.

Before that, words that can't be in a run long enough are left out: of three consecutive words in a run of least length 6 and least exponent 4
there are three copies at least within the run (LEAST in general). Trigrams met less often break a document into stretches, these are
counted by themselves again, and a document's trees are built over its stretches, each ended by a mark of its own. Counting is by
hash: a collision leaves a word in, never out.

A document is worked on in one place; its trees take about 500 bytes for each word of its stretches. Batches of documents are cut to SLICE bytes.

Defined cases: a null, empty or blank text has no words, no runs, and an empty collapsed text; a null or repeated key is a row like any
other; repeated rows give a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WORD, text_of

SLICE = 4 << 20
ROUNDS = 6
TABLE_BITS = 22


# --- one text ---------------------------------------------------------------------------------------------------------------------


class SuffixTree:
    """The suffix tree of a list of numbers of which the last, 0, occurs once: leaves in the order of suffixes, and common extensions."""

    def __init__(self, symbols: list[int], kinds: int):
        """``kinds``: above every symbol."""
        self.n, self.kinds = len(symbols), kinds
        self._build(symbols)
        keys = np.fromiter(self._edges, np.int64, len(self._edges))
        children = np.fromiter(self._edges.values(), np.int64, len(self._edges))
        del self._edges
        order = np.argsort(keys)
        keys, self._children = keys[order], children[order]
        self._first = np.searchsorted(keys // kinds, np.arange(len(self._start) + 1)).tolist()
        self._ends_now = (keys % kinds == 0).tolist()
        self._children = self._children.tolist()

    def _build(self, s: list[int]) -> None:
        n, kinds, edges = self.n, self.kinds, {}
        start, end, link = [0], [0], [0]  # the edge into a node; its suffix link
        node = edge = length = pending = todo = 0
        for i, symbol in enumerate(s):
            todo += 1
            pending = 0
            while todo:
                if not length:
                    edge = i
                at = node * kinds + s[edge]
                child = edges.get(at)
                if child is None:
                    edges[at] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    begun = start[child]
                    span = end[child] - begun
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if s[begun + length] == symbol:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    split = len(start)
                    start += (begun, i)
                    end += (begun + length, n)
                    link += (0, 0)
                    edges[at] = split
                    edges[split * kinds + symbol] = split + 1
                    start[child] = begun + length
                    edges[split * kinds + s[begun + length]] = child
                    if pending:
                        link[pending] = split
                    pending = split
                todo -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - todo + 1
        self._start, self._end, self._edges = start, end, edges

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order (``falling``: of the greatest symbol first, but the end still before all), and of the Euler tour between two
        neighbouring leaves the least depth, that of their lowest common ancestor."""
        start, end, first, children = self._start, self._end, self._first, self._children
        depth = [0] * len(start)
        parent = [0] * len(start)
        suffixes, least = [], []
        stack, low, n = [0], 0, self.n
        while stack:
            node = stack.pop()
            up = depth[parent[node]]
            if low < 0:
                low = up  # the tour comes back from a leaf to this node's parent
            down = depth[node] = up + end[node] - start[node]
            a, b = first[node], first[node + 1]
            if a == b:
                suffixes.append(n - down)
                least.append(low)
                low = -1
                continue
            below = children[a:b]
            if not falling:
                below = below[::-1]
            elif self._ends_now[a]:
                below = below[1:] + below[:1]
            for child in below:
                parent[child] = node
            stack += below
        return np.array(suffixes, np.int64), np.array(least, np.int32)


class Extensions:
    """Longest common extensions of the positions of a sequence, from its tree's tour."""

    def __init__(self, suffixes: np.ndarray, least: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.table = [least]
        step = 1
        while 2 * step <= len(least):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` and ``b`` differ everywhere."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.table[k][low[here]], self.table[k][high[here] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each position the next one with a smaller rank: the end of the longest Lyndon word that starts there."""
    found, stack = [0] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        own = rank[i]
        while stack and rank[stack[-1]] > own:
            stack.pop()
        found[i] = stack[-1] if stack else len(rank)
        stack.append(i)
    return np.array(found, np.int64)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of a sequence of numbers from 1 on; the period fits twice at least."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    kinds = int(symbols.max()) + 1
    tree = SuffixTree([*symbols.tolist(), 0], kinds)
    suffixes, least = tree.tour()
    falling = tree.tour(falling=True)[0]
    del tree
    forward = Extensions(suffixes, least)
    backward = Extensions(*SuffixTree([*symbols[::-1].tolist(), 0], kinds).tour())
    other = np.empty(n + 1, np.int64)
    other[falling] = np.arange(n + 1)
    i = np.arange(n)
    found = []
    for rank in (forward.rank, other):
        j = _next_smaller(rank.tolist())[:n]
        # position x of the sequence is n - 1 - x of its reversal; what is before the first is its end
        end, start = j + forward(i, j), i - backward(n - i, n - j)
        good = end - start >= 2 * (j - i)
        found.append(np.stack([start, end, j - i], 1)[good])
    return np.unique(np.concatenate(found), axis=0)


# --- batches of texts -------------------------------------------------------------------------------------------------------------


def _stretches(words: np.ndarray, ends: np.ndarray, length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """words: numbers of all words of a batch; ends: of its documents. First words of stretches that may hold runs, and what follows their last."""
    size = np.diff(ends, prepend=0)
    # of each trigram of a run there are so many in it
    often, fewest = min(exponent - 1, max(length, exponent) - 2), max(length, exponent) - 2
    if often < 2 or fewest < 1:
        return ends - size, ends
    piece = np.repeat(np.arange(len(ends), dtype=np.uint64), size)
    at = np.flatnonzero(piece[2:] == piece[:-2]) if len(piece) > 2 else np.zeros(0, np.int64)
    piece = piece[at]
    w = words.astype(np.uint64)
    grams = np.zeros(len(at), np.uint64)
    for k in range(3):
        grams = (grams ^ w[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    first = last = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        h = ((grams + piece * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - TABLE_BITS)
        h = h.astype(np.int64)
        keep = np.bincount(h, minlength=1)[h] >= often if len(h) else np.zeros(0, bool)
        kept = at[keep]
        opens = np.diff(kept, prepend=-2) != 1
        number = np.cumsum(opens) - 1
        held = np.bincount(number, minlength=0)
        long = held[number] >= fewest if len(number) else np.zeros(0, bool)
        first, last = kept[opens & long], kept[(np.diff(kept, append=-2) != 1) & long]
        if len(kept[long]) == len(at):
            break
        at, grams, piece = kept[long], grams[keep][long], number[long].astype(np.uint64)
    return first, last + 3


class RunFinder:
    """Runs of at least ``length`` words and ``exponent`` periods in batches of texts."""

    def __init__(self, length: int, exponent: int):
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.length, self.exponent = length, exponent

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """For each text the number of words, its runs (start, length, period) by start and period, and the text without what runs repeat."""
        split = [t.split() for t in texts]  # bytes: blanks are those of ASCII
        ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        first, last = _stretches(coded, ends, self.length, self.exponent)
        doc = np.searchsorted(ends, first, "right")
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        for number, words in enumerate(split):
            a, b = cuts[number], cuts[number + 1]
            begin = int(ends[number]) - len(words)
            runs = self._of_document(coded, first[a:b], last[a:b], begin) if b > a else np.zeros((0, 3), np.int64)
            if not len(runs):
                yield len(words), runs, b" ".join(words)
                continue
            change = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(words) + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=len(words) + 1)
            keep = np.cumsum(change)[: len(words)] == 0
            yield len(words), runs, b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])

    def _of_document(self, coded: np.ndarray, first: np.ndarray, last: np.ndarray, begin: int) -> np.ndarray:
        parts = [np.arange(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        where = np.concatenate([np.append(p, -1) for p in parts])  # -1: a stretch's end
        marks = where < 0
        kinds, symbols = np.unique(coded[where[~marks]], return_inverse=True)
        text = np.empty(len(where), np.int64)
        text[~marks] = symbols + 1
        text[marks] = len(kinds) + 1 + np.arange(len(parts))
        found = runs_of(text)
        size = found[:, 1] - found[:, 0]
        found, size = (x[(size >= self.length) & (size >= self.exponent * found[:, 2])] for x in (found, size))
        out = np.stack([where[found[:, 0]] - begin, size, found[:, 2]], 1)
        return out[np.lexsort((out[:, 2], out[:, 0]))]


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 6, exponent: int = 4) -> DataFrame:
    """``key``, n_words, runs (an array of start, length and period, in words, by start and period) and collapsed: the words that no run
    holds after its first period, joined by one space. Runs have ``length`` words and ``exponent`` periods at least."""
    kind = df.schema[key].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = RunFinder(length, exponent)

        def give(keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            counts, runs, collapsed = zip(*finder(texts), strict=True)
            flat = np.concatenate(runs)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(item))
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(collapsed, pa.binary())],
                [key, "n_words", "runs", "collapsed"],
            )

        for batch in batches:
            held, size, began = [], 0, 0
            for at, value in enumerate(batch.column(1)):
                own = value.as_py() or b""
                if held and size + len(own) > SLICE:
                    yield give(batch.column(0).slice(began, at - began), held)
                    held, size, began = [], 0, at
                held.append(own)
                size += len(own)
            if held:
                yield give(batch.column(0).slice(began), held)

    schema = f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    found = df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


# --- the query --------------------------------------------------------------------------------------------------------------------


def with_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text``, every tenth text by a hash of its key with a periodic tail: from word a on the next p words over and over. A null key changes nothing."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    # the words are a column of their own, so that each word of a tail doesn't split the text again
    split = docs.select(key, text, F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("_words"))
    words = F.col("_words")
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    placed = split.select(key, text, "_words", a.alias("_a"), p.alias("_p"))
    tail = F.transform(F.sequence("_a", F.size(words) - 1), lambda i: F.element_at(words, F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1))
    changed = F.array_join(F.concat(F.slice(words, 1, F.col("_a")), tail), " ")
    return placed.select(key, F.when(F.size(words) > 0, changed).otherwise(F.col(text)).alias(text))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole text of documents, a tenth with periodic tails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_of(F.col("text")).alias("text"))
    found = find_runs(with_tails(docs))
    # arrays compare by their items: the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
