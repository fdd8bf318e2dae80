"""Dedup of near-equal lines by MinHash.

A line, without blanks at its ends, has the set of its character shingles of SHINGLE characters (a shorter line is its one shingle). Signatures
are cut into BANDS bands of ROWS minhashes; lines that agree in a band are candidates (at similarity 0.8 with 3 x 10 that finds 99.9 %), and the
whole sets decide. Links are joined to components by distributed union-find, and the first line of each component, by key, then
number, stays.

Equal lines are one node (by hash) and are compared once. The lines of a band are compared to its head, the line met most often, in two steps:
within each Arrow batch first, and then the heads of the batches. A band that very many lines share thus sends one row a batch, and its
lines make no pairs among themselves. Bands that end up with lines of several components are looked at again: all pairs of
different components are held against each other by size and parity sketch inside one join on the band, which gives only those that may be similar. In a
band of more than MOST lines, pairs are found by their rarest shingles instead (``setjoin``, complete for the similarity). So no candidate
pair that could join components goes unchecked.

Every join asks for the merge join: all tables here grow with the input, and such as Spark holds to be small by their files (dictionaries, equal
sketches, exploded rows) unfold to many times that in the driver when they are broadcast.

Defined cases: blank lines and null or empty texts have no lines to drop; lines equal up to blanks at their ends are equal; repeated rows
(equal key and text) have equal line places, and these stand or fall together; null keys come first; an empty table gives an empty
result. Two different lines with one 64-bit hash (told apart by 64 more bits) stay, unlinked. Sets are compared as 56-bit hashes of
their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from .components import connected_components
from .setjoin import prefix_pairs

SHINGLE, PERCENT = 8, 80  # the first a power of 2
ROWS, BANDS = 3, 10
BLOCK = 1 << 15  # characters that are hashed together
TOGETHER = 256  # lines whose sets are made together
SKETCH = 1024
MOST = 4096  # lines of a band of which all pairs are looked at in one join
SEEN = 500_000  # lines whose bands a task remembers to have given already
SALTS = 8  # tasks that the lines of one component are dealt to
PARTS = [f"sketch_{i}" for i in range(SKETCH // 64)]
_FACTORS = np.random.default_rng(8).integers(0, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def lines(text: str | None) -> list[tuple[int, str]]:
    """Number (from 0) and stripped text of every line that isn't blank."""
    return [(k, s) for k, line in enumerate((text or "").split("\n")) if (s := line.strip())]


def line_hash(line: str) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _blocks(sizes: list[int], most: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of at most ``most`` rows of ``size`` characters in all, or of one larger row."""
    k = 0
    while k < len(sizes):
        end, taken = k + 1, sizes[k]
        while end < min(len(sizes), k + most) and taken + sizes[end] <= size:
            taken += sizes[end]
            end += 1
        yield k, end
        k = end


def _windows(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all lines in a row; which lines have a shingle's length; how many shingles these have; where each starts."""
    codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(size) - size
    whole = np.flatnonzero(size >= SHINGLE)
    n = size[whole] - (SHINGLE - 1)
    return codes, whole, n, np.repeat(starts[whole] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every SHINGLE neighbouring characters, from halves to wholes."""
    h, width = codes * np.uint32(0x9E3779B1), 1
    while width < SHINGLE:
        h = (h[:-width] ^ (h[:-width] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(13))


def _wide_hashes(codes: np.ndarray) -> np.ndarray:
    """The same in 64 bits."""
    h, width = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < SHINGLE:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def band_keys(found: list[str]) -> np.ndarray:
    """A row of BANDS 64-bit keys for each line."""
    factors = _FACTORS[: ROWS * BANDS, None]
    least = np.empty((ROWS * BANDS, len(found)), np.uint32)
    for k, end in _blocks(list(map(len, found)), len(found), BLOCK):
        codes, whole, n, at = _windows(found[k:end])
        if len(whole):
            grams = _shingle_hashes(codes)[at]
            if len(grams) <= BLOCK:
                least[:, k + whole] = np.minimum.reduceat(factors * grams, np.cumsum(n) - n, axis=1)
            else:  # one long line
                least[:, k] = np.min([(factors * grams[b : b + BLOCK]).min(1) for b in range(0, len(grams), BLOCK)], axis=0)
        for row in np.setdiff1d(np.arange(end - k), whole):
            least[:, k + row] = factors[:, 0] * np.uint32(int.from_bytes(line_hash(found[k + row])[:4], "little"))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.T.reshape(-1, BANDS, ROWS).transpose(2, 0, 1):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + column
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def packed_sets(found: list[str]) -> np.ndarray:
    """At most 256 lines: 56 bits of the hash of each distinct shingle, behind 8 bits of the line's number; ascending."""
    codes, whole, n, at = _windows(found)
    short = np.setdiff1d(np.arange(len(found)), whole)
    own = [_wide_hashes(codes)[at]] if len(whole) else []
    own.append(np.array([int.from_bytes(line_hash(found[k])[:8], "little") for k in short], np.uint64))
    row = np.concatenate([np.repeat(whole, n), short]).astype(np.uint64)
    return _distinct(row << np.uint64(56) | np.concatenate(own) >> np.uint64(8))


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _sizes(packed: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount((packed >> np.uint64(56)).astype(np.int64), minlength=rows)


def sketches(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Size of each line's set, and SKETCH bits as longs: each is the parity of the members that fall on it."""
    sizes, bits = np.zeros(len(found), np.int64), np.zeros((len(found), SKETCH // 64), np.int64)
    for k, end in _blocks(list(map(len, found)), TOGETHER, BLOCK):
        packed = packed_sets(found[k:end])
        row = (packed >> np.uint64(56)).astype(np.int64)
        parity = np.bincount(row * SKETCH + (packed & np.uint64(SKETCH - 1)).astype(np.int64), minlength=(end - k) * SKETCH).astype(np.uint8) & 1
        sizes[k:end], bits[k:end] = _sizes(packed, end - k), np.packbits(parity).view(np.int64).reshape(end - k, -1)
    return sizes, bits


def similar(a: list[str], b: list[str], percent: int) -> np.ndarray:
    """Whether the whole sets of a[k] and b[k] have a similarity of percent / 100 or more."""
    out = np.zeros(len(a), bool)
    for k, end in _blocks([len(x) + len(y) for x, y in zip(a, b, strict=True)], TOGETHER, BLOCK):
        first, second = packed_sets(a[k:end]), packed_sets(b[k:end])
        union = _sizes(_distinct(np.concatenate([first, second])), end - k)
        out[k:end] = (_sizes(first, end - k) + _sizes(second, end - k) - union) * 100 >= union * percent
    return out


def _ranked(keys: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys with their last 8 bits used for a rank: lines met often come first, others in an order that differs by key."""
    often = np.uint64(15) - np.minimum(np.log2(counts), 15).astype(np.uint64)
    mixed = (keys.view(np.uint64) ^ nodes.view(np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)
    return (keys.view(np.uint64) & ~np.uint64(255) | often[:, None] << np.uint64(4) | mixed).view(np.int64)


def line_table(docs: DataFrame) -> DataFrame:
    """docs: id, text, t. Every line that isn't blank: id, t, no, node and check (128 bits of its hash), and, once a task, its bands.

    alone: ranked keys of the bands in which the line has to meet lines of other batches. met: key and head of the bands in which it has met
    others in its own batch. A head has its key in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows, numbers, hashes, new, times = [], [], [], {}, {}
            for row, text in enumerate(batch.column(1)):
                for k, line in lines(text.as_py()):
                    h = line_hash(line)
                    if h in times:
                        times[h] += 1
                    elif h not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        new[len(rows)], times[h] = line, 1
                    rows.append(row)
                    numbers.append(k)
                    hashes.append(h)
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            place = np.fromiter(new, np.int64, len(new))
            node = both[place, 0]
            keys = _ranked(band_keys(list(new.values())), node, np.fromiter(times.values(), np.int64, len(new))).ravel()
            # lines of one key come together, its head first
            order = np.argsort(keys)
            group = keys[order] >> 8
            starts = np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]])
            of = np.cumsum(starts) - 1
            alone, met, heads = np.empty(len(keys), bool), np.empty(len(keys), bool), np.empty(len(keys), np.int64)
            alone[order], met[order], heads[order] = starts, np.bincount(of)[of] > 1, node[order[starts] // BANDS][of]

            def listed(chosen: np.ndarray, values: pa.Array) -> pa.Array:
                counts = np.zeros(len(rows) + 1, np.int64)
                counts[1 + place] = chosen.reshape(-1, BANDS).sum(1)
                return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), values)

            pairs = pa.StructArray.from_arrays([pa.array(keys[met] >> 8), pa.array(heads[met])], ["key", "head"])
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(2).take(taken), pa.array(numbers, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), listed(alone, pa.array(keys[alone])), listed(met, pairs)],
                ["id", "t", "no", "node", "check", "alone", "met"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "t").mapInArrow(run, f"id {kind}, t long, no int, node long, check long, alone array<long>, met array<struct<key: long, head: long>>")


def with_heads(rows: DataFrame) -> DataFrame:
    """rows: key (ranked), node. key, node and head (the first node of that key) of keys with several nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, told = None, 0, True  # key, its head, whether that was given
        for batch in batches:
            key, node = batch.column(0).to_numpy() >> 8, batch.column(1).to_numpy()
            if not len(key):
                continue
            starts = np.concatenate([[key[0] != last or last is None], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(starts, np.arange(len(key)), -1))
            heads = np.where(at < 0, head, node[at])
            told = told and not starts[0]
            others = np.flatnonzero(node != heads)
            first = others[np.concatenate([[True], key[others][1:] != key[others][:-1]])] if len(others) else others
            if len(first) and told and at[first[0]] < 0:
                first = first[1:]
            if len(others):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[others], key[first]])), pa.array(np.concatenate([node[others], heads[first]])), pa.array(np.concatenate([heads[others], heads[first]]))], ["key", "node", "head"])
            told = bool(len(others)) and key[others[-1]] == key[-1] or told and at[-1] < 0
            last, head = key[-1], heads[-1]

    return rows.repartition(F.shiftright("key", 8)).sortWithinPartitions("key").mapInArrow(run, "key long, node long, head long")


def band_members(table: DataFrame) -> DataFrame:
    """key, node and head (of the batch, or of all) of the lines of bands with several lines."""
    alone = table.select(F.explode("alone").alias("key"), "node")
    met = table.select(F.explode("met").alias("met"), "node").select("met.key", "node", "met.head")
    return with_heads(alone).unionByName(met)


def lines_of(wanted: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted: node. first: node, place (id, t, no). node, line, n (size of its set) and the parts of its sketch, lifted from the texts and written.

    The texts are shuffled in the same way at every size. Of repeated rows, which come together, one is read; a node is given again only
    where adaptive execution deals very many of them to several tasks.
    """
    places = wanted.distinct().join(first.hint("merge"), "node")
    places = places.groupBy(F.col("place.id").alias("_id"), F.col("place.t").alias("_t")).agg(F.collect_list(F.struct(F.col("place.no").alias("no"), "node")).alias("wanted"))
    holders = docs.join(places.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("text", "wanted")

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes, texts = [], []
            for text, asked in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if asked[0]["node"] != last:
                    last, own = asked[0]["node"], text.as_py().split("\n")
                    nodes += [w["node"] for w in asked]
                    texts += [own[w["no"]].strip() for w in asked]
            sizes, bits = sketches(texts)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes), *map(pa.array, bits.T)], ["node", "line", "n", *PARTS])

    lifted = holders.mapInArrow(lift, "node long, line string, n long, " + ", ".join(f"{x} long" for x in PARTS))
    return durable(lifted.hint("rebalance", "node"), "wanted-lines")


def members_of(found: DataFrame) -> DataFrame:
    """found: node, line. A row for each shingle of each line: node, n, member (a hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, end in _blocks(list(map(len, texts)), TOGETHER, BLOCK):
                packed = packed_sets(texts[k:end])
                rows = k + (packed >> np.uint64(56)).astype(np.int64)
                n = _sizes(packed, end - k)[rows - k]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n), pa.array((packed & np.uint64(2**56 - 1)).view(np.int64))], ["node", "n", "member"])

    return found.select("node", "line").mapInArrow(run, "node long, n long, member long")


def _side(found: DataFrame, name: str, *more: Column | str) -> DataFrame:
    return found.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), *[F.col(x).alias(f"{x}_{name}") for x in PARTS], *more)


def _near(percent: int) -> Column:
    """Whether sets of a and b may be similar: sketches differ in at most as many bits as the sets in members."""
    bits = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in PARTS), F.lit(0))
    alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return alike & (bits * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def near_pairs(pairs: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs: a, b (nodes). found: node, n and sketches. The pairs that may be similar, written."""
    return durable(pairs.join(_side(found, "b").hint("merge"), "b").join(_side(found, "a").hint("merge"), "a").filter(_near(percent)).select("a", "b"), "line-pairs")


def verified(pairs: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs: a, b. found: node, line. The pairs whose whole sets are similar enough, as u and v."""
    second = pairs.join(found.select(F.col("node").alias("b"), F.col("line").alias("line_b")).hint("merge"), "b")
    both = second.join(found.select(F.col("node").alias("a"), F.col("line").alias("line_a")).hint("merge"), "a").select("a", "b", "line_a", "line_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return durable(both.mapInArrow(compare, "u long, v long"), "line-links")


def open_pairs(placed: DataFrame, found: DataFrame, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """placed: key, node, component; distinct rows. found: node, line, n and sketches. a and b (a < b) of different components that share a key and may be similar.

    A key of two lines has been compared already.
    """
    counted = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    several = counted.filter("low <> high and members > 2").select("key", (F.col("members") <= most).alias("few"))
    rows = durable(placed.join(several.hint("merge"), "key"), "line-open")
    few = rows.filter("few").groupBy("node", "component").agg(F.sort_array(F.collect_set("key")).alias("keys")).join(found.drop("line").hint("merge"), "node")
    few = durable(few.withColumn("key", F.explode("keys")), "line-few")
    left, right = (_side(few, s, "key", F.col("component").alias(f"c_{s}"), F.col("keys").alias(f"keys_{s}")) for s in "ab")
    # a pair of several bands is met in the first of them
    here = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    met = left.join(right.hint("merge"), "key").filter((F.col("c_a") < F.col("c_b")) & _near(percent) & here).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    loose = durable(rows.filter("NOT few").select("node", "component").distinct(), "line-loose")
    shingles = durable(members_of(found.join(loose.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])).join(loose.hint("merge"), "node"), "line-shingles")
    rare = near_pairs(prefix_pairs(shingles, percent), found, percent)
    return met.unionByName(rare).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs: id, text. Of every line that isn't blank: id, line_no, keep_id and keep_line_no (the line that stays for it) and kept."""
    docs = docs.select("id", "text", F.xxhash64("text").alias("t"))
    table = durable(line_table(docs), "lines")
    place = F.struct("id", "t", "no")
    nodes = table.groupBy("node").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    nodes = durable(nodes.select("node", "place", "n", (F.col("low") == F.col("high")).alias("sure")), "line-nodes")
    first = nodes.filter("sure").select("node", "place")

    members = durable(band_members(table), "line-members")
    found = lines_of(members.select("node"), first, docs)
    tested = members.filter("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    tested = near_pairs(tested, found)
    of_heads = connected_components(verified(tested, found))
    placed = members.select("key", "node").distinct().join(of_heads.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    rest = open_pairs(durable(placed, "line-placed"), found).join(tested.hint("merge"), ["a", "b"], "left_anti")
    links = of_heads.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(verified(rest, found))

    # the first line of each component, by place; only of lines that have another
    in_components = durable(connected_components(links).join(first.hint("merge"), "node"), "line-components")
    heads = in_components.groupBy("component").agg(F.min("place").alias("head")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = in_components.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(heads.hint("merge"), ["component", "salt"]).select("node", "head")
    alone = nodes.filter("sure and n > 1").join(linked.hint("merge"), "node", "left_anti").select("node", F.col("place").alias("head"))
    decided = durable(linked.unionByName(alone), "line-heads")
    out = table.select("id", "t", "no", "node").join(decided.hint("merge"), "node", "left")
    keep = F.coalesce("head", place)
    return out.select("id", F.col("no").alias("line_no"), keep["id"].alias("keep_id"), keep["no"].alias("keep_line_no"), (keep == place).alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return dedup_lines(docs).withColumnsRenamed({"id": "doc_id", "keep_id": "keep_doc_id"})
