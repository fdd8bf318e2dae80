"""Substring, line and near dedup, BPE, language and the pipeline against brute force, odd cases included."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graintable.llm import bpe, components, language, line_dedup, minhash, mixing, setjoin, substring_dedup

from .conftest import ROWS

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    groups = Groups()
    for a, b in links:
        groups.join(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: groups.find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_prefix_pairs_are_complete(spark):
    rng = np.random.default_rng(4)
    base = list(range(100))
    sets = []
    for node in range(60):
        drop = set(rng.choice(100, rng.integers(0, 25), replace=False).tolist())
        sets.append({x for x in base if x not in drop} | {1000 + int(x) for x in rng.integers(0, 60, rng.integers(0, 12))})
    rows = [(n, n, len(s), int(m)) for n, s in enumerate(sets) for m in s]
    got = {(r["a"], r["b"]) for r in setjoin.prefix_pairs(spark.createDataFrame(rows, "node long, component long, n long, member long"), 80).collect()}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and want <= got


def word_sets(docs, width):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.setdefault(d, set()).update({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


@pytest.mark.parametrize("where", [SF, "odd"])
def test_near_duplicates_by_brute_force(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    sets = word_sets([(r[0], r[1]) for r in rows if r[0] is not None], 2)
    groups, ids = Groups(), sorted(sets)
    for i, a in enumerate(ids):
        groups.find(a)
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = minhash.op7_minhash(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), groups.find(r["doc_id"]), groups.find(r["doc_id"]) == r["doc_id"])


def test_near_duplicates_of_a_large_family(spark, tmp_path):
    """Copies with one to fifteen per cent of their words changed: some are linked, some by others only, some not at all."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            words[at] = f"e{rng.integers(0, 400)}"
        rows.append((n, " ".join(words)))
    sets, groups = word_sets(rows, 2), Groups()
    for a in range(150):
        groups.find(a)
        for b in range(a + 1, 150):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r["id"]: r["component"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "id long, text string"), width=2).collect()}
    assert got == {n: groups.find(n) for n in range(150)} and 1 < len(set(got.values())) < 150


@pytest.mark.parametrize("where", [SF, "odd"])
def test_substring_dedup_by_brute_force(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(((r[0] is not None, r[0] or 0), r[1]) for r in rows if r[1] is not None)
    first, cut = {}, defaultdict(set)
    for key, text in order:
        for start, end, h in substring_dedup.runs(text):
            if first.setdefault(h, (key, text, start)) != (key, text, start):
                cut[key, text].update(range(start, end))
    got = Counter((r["doc_id"], r["text"], r["removed_chars"]) for r in substring_dedup.op3_substring_dedup(spark, d).collect())
    want = Counter()
    for r in rows:
        gone = cut[(r[0] is not None, r[0] or 0), r[1]] if r[1] is not None else set()
        want[r[0], None if r[1] is None else "".join(c for i, c in enumerate(r[1]) if i not in gone), len(gone)] += 1
    assert got == want


def _aligned_repeats(rows):
    """The words that are left of every document: word by word, from each sentence's start, equal texts are followed as far as they go."""
    docs = []
    for key, text in sorted((r[0], r[1]) for r in rows if r[1]):
        words = [(m[1], bool(not m[2] or re.search(r"[\n\v\f\r]", m[2]) or (m[1][-1] in ".!?" and m[2][0] in " \t"))) for m in re.finditer(r"(\S+)(\s*)", text)]
        docs.append((key, words, [i for i in range(len(words)) if i == 0 or words[i - 1][1]], set()))
    at = defaultdict(list)
    for d, (_, words, starts, _) in enumerate(docs):
        for i in starts:
            at[tuple(words[i : i + 16])].append((d, i))
    for head, places in at.items():
        for n, (d, i) in enumerate(places if len(head) == 16 else []):
            for e, j in places[:n]:
                own, other, size, whole, ends = docs[d][1], docs[e][1], 0, 0, 0
                while i + size < len(own) and j + size < len(other):
                    if own[i + size] != other[j + size]:
                        break
                    size += 1
                    if own[i + size - 1][1]:
                        whole, ends = size, ends + 1
                        if ends == 1 and whole >= 25 or ends > 1 and whole >= 16:
                            docs[d][3].update(range(i, i + whole))
    return Counter((key, tuple(w for n, (w, _) in enumerate(words) if n not in gone)) for key, words, _, gone in docs)


def test_substring_dedup_by_words(spark):
    """Passages of short sentences and short lines too, against a search that knows no runs."""
    rng = np.random.default_rng(5)
    verse = "\n".join(f"line {i} of verse" for i in range(14))
    items = "\n".join(f"item{i}" for i in range(60))
    talk = " ".join(f"Yes{i}. No{i}! Why?" for i in range(20))
    tail = " ".join(f"long{i}" for i in range(20)) + ". Short end. So be it. "
    rows = [(n, f"Own start {n}.\n{x}\nOwn end {n}.") for n, x in enumerate([verse, items, talk, verse, items, talk, f"{tail}Then {verse}", tail])]
    small = ["a b c.", "d.", "e f!", "g\n", "h i j k l m n o p q.", "r s t u v w x y z a b c d e f g h i j k l m n o p q."]
    rows += [(100 + n, " ".join(small[i] for i in rng.integers(0, len(small), 40))) for n in range(30)]
    got = {r["id"]: r["text"] for r in substring_dedup.cut_repeats(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert Counter((k, tuple(t.split())) for k, t in got.items()) == _aligned_repeats(rows)
    for n in (3, 4, 5):
        assert got[n].split() == f"Own start {n}. Own end {n}.".split()
    assert got[7].split() == "Own start 7. Own end 7.".split()
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = Counter((r["doc_id"], tuple(r["text"].split())) for r in substring_dedup.op3_substring_dedup(spark, SF).collect() if r["text"] or r["removed_chars"])
    assert got == _aligned_repeats(real)


def test_planted_passages_go_and_clean_texts_stay(spark):
    passage = "It was a bright cold day in April and the clocks were striking thirteen as he slipped in. His chin was nuzzled into his breast to escape the vile wind that blew. Nobody saw him come through the glass doors of the mansions that day, though not quickly enough to keep the swirl of dust from entering along with him."
    rows = [(i, f"Own beginning number {i} of this text. {passage} Own ending number {i} of it.") for i in range(5)] + [(9, "A clean text that nobody else has. It is short and it stays. Yes. Yes. Yes.")]
    got = {r["id"]: r["text"] for r in substring_dedup.cut_repeats(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[-1][1]
    assert all("bright cold day" not in got[i] and f"beginning number {i}" in got[i] for i in range(1, 5))


def line_set(line):
    return {line[k : k + 8] for k in range(len(line) - 7)} or {line}


@pytest.mark.parametrize("where", [SF, "odd"])
def test_line_dedup_by_brute_force(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    places, first = [], {}
    for key, text in sorted(((r[0] is not None, r[0] or 0), r[1] or "") for r in rows):
        for k, line in enumerate(text.split("\n")):
            if line := line.strip():
                places.append((key, k, line))
                first.setdefault(line, (key, k))
    sets = [(line_set(line), p) for line, p in first.items()]
    groups = Groups()
    for _, p in sets:
        groups.find(p)
    at = defaultdict(list)
    for i, (s, _) in enumerate(sets):
        for g in s:
            at[g].append(i)
    shared = Counter((i, j) for found in at.values() for n, i in enumerate(found) for j in found[n + 1 :])
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i][0]) + len(sets[j][0]) - n):
            groups.join(sets[i][1], sets[j][1])
    want = Counter((key, k, groups.find(first[line])) for key, k, line in places)
    flat = lambda x: (x is not None, x or 0)
    got = Counter((flat(r["doc_id"]), r["line_no"], (flat(r["keep_doc_id"]), r["keep_line_no"])) for r in line_dedup.op8_line_dedup(spark, d).collect())
    assert got == want


def test_band_heads_across_batches(spark):
    """Ranked keys: the head of a key has its smallest rank."""
    rng = np.random.default_rng(8)
    rows = [(int(k), int(r), int(n)) for k, r, n in zip(rng.integers(-20, 20, 900), rng.integers(1, 256, 900), rng.integers(0, 30, 900), strict=True)]
    rows += [(99, 1 + n % 255, n % 500) for n in range(1000)] + [(99, 0, 123)] + [(100 + n, n, n) for n in range(50)] + [(7000, n, 5) for n in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in line_dedup.with_heads(spark.createDataFrame([(k * 256 + r, n) for k, r, n in rows], "key long, node long")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nodes, best = defaultdict(set), {}
    for k, r, n in rows:
        nodes[k].add(n)
        best[k] = min(best.get(k, 256), r)
    want = {k: v for k, v in nodes.items() if len(v) > 1}
    assert {(k, n) for k, n, _ in got} == {(k, n) for k, v in want.items() for n in v}
    for key in want:
        heads = {h for k, _, h in got if k == key}
        assert len(heads) == 1 and heads <= {n for k, r, n in rows if k == key and r == best[key]}
        assert sum(n == h for k, n, h in got if k == key) == 1


def test_line_sets_in_blocks(monkeypatch):
    """Sizes, sketches and comparisons don't depend on which lines are worked on together."""
    rng = np.random.default_rng(11)
    found = ["".join(rng.choice(list("abcé日😀 "), rng.integers(1, 60))) for _ in range(700)] + ["x", "x" * 7, "x" * 8, "x" * 90_000]
    other = [line[:-3] + "zz" if k % 2 else line + "y" for k, line in enumerate(found)]
    want = [len(line_set(a) & line_set(b)) * 100 >= 80 * len(line_set(a) | line_set(b)) for a, b in zip(found, other, strict=True)]
    for block, together in ((1 << 15, 256), (100, 3), (1 << 20, 200)):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "TOGETHER", together)
        assert line_dedup.similar(found, other, 80).tolist() == want and 100 < sum(want) < 600
        sizes, bits = line_dedup.sketches(found)
        assert sizes.tolist() == [len(line_set(x)) for x in found]
        keys = line_dedup.band_keys(found)
        if block != 1 << 15:
            assert (bits == before[0]).all() and (keys == before[1]).all()
        before = bits, keys
    flipped = np.unpackbits((line_dedup.sketches(found)[1] ^ line_dedup.sketches(other)[1]).view(np.uint8), axis=1).sum(1)
    assert all(f <= len(line_set(a) ^ line_set(b)) for f, a, b in zip(flipped, found, other, strict=True))


@pytest.mark.parametrize("most", [4096, 4])
def test_lines_of_a_large_family(spark, monkeypatch, most):
    """With few and with many lines a band: all pairs of a band, or those with rare shingles in common."""
    monkeypatch.setattr(line_dedup.open_pairs, "__defaults__", (80, most))
    rng = np.random.default_rng(9)
    base = [f"word{i}" for i in range(60)]
    rows = []
    for n in range(120):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 8), replace=False):
            words[at] = f"edit{rng.integers(0, 300)}"
        rows.append((n, " ".join(words)))
    sets, groups = [line_set(t) for _, t in rows], Groups()
    for a in range(120):
        groups.find(a)
        for b in range(a + 1, 120):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r["id"]: r["keep_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {n: groups.find(n) for n in range(120)} and 1 < len(set(got.values())) < 120


def test_bpe_matches_the_library(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = Counter(tuple(r) for r in bpe.op5_bpe(spark, odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = Counter()
    for d, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want


def test_bpe_round_trip_and_random_words():
    from tokenizers import Tokenizer

    tokenizer, vocab, rng = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path()), np.random.default_rng(6)
    for letters in ("ab", "abcde", "abcdefghijklmnopqrstuvwxyz", "aàéî日😀'1-"):
        for n in (1, 2, 3, 8, 30, 200):
            text = " ".join("".join(rng.choice(list(letters), n)) for _ in range(30))
            ids = np.frombuffer(b"".join(vocab.encode(text)), "<u4")
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want and vocab.decode(ids).decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_cuts_long_texts_at_blanks_only(monkeypatch):
    """Pieces and full caches don't change a text's ids, whatever characters Python takes for blanks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    for c in "\x1c\x1d\x1e\x1f\x85\xa0\u200b\u2028":
        for text in ("a " * (bpe.PIECE // 2) + f"!!!{c}!!! end", "x" * (bpe.PIECE - 1) + f"{c}y z"):
            got = np.frombuffer(b"".join(bpe.vocabulary(bpe.default_path()).encode(text)), "<u4")
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "CACHE", 3)
    vocab, text = bpe.Vocabulary(bpe.default_path()), " ".join(f"w{i % 5} v{i % 11}, u{i}" for i in range(200))
    assert np.frombuffer(b"".join(vocab.encode(text)), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(vocab.words) <= 3 and len(vocab.words.old) <= 3


def test_language_is_found_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op6_language(spark, d).filter("held_out").collect()
    assert len(got) > 150 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) / len(got) > 0.98


def test_language_odd_cases(spark, odd, empty):
    got = language.op6_language(spark, odd).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) if r["doc_id"] is not None else None
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert language.op6_language(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(docs, language.train(docs)).collect()} == {"und"}
    kept = language.keep_identified(docs, language.train(docs))
    assert kept.columns == docs.columns and {4, 5, 6, 7} & {r["doc_id"] for r in kept.collect()} == set()


def plain_grams(text):
    """Counts of the buckets of all n-grams, one string at a time; None without a letter."""
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    if not s.strip():
        return None
    s, out = " " + " ".join(s.split()) + " ", Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x2545F4914F6CDD1 + (ord(c) if c != " " else 0) * 0x9E3779B97F4A7C1) % 2**64
            out[h >> 31 & (1 << 15) - 1] += 1
    return out


def test_language_by_brute_force(spark):
    """Document frequencies, TF-IDF, logits and scores worked out one text at a time, with the weights that training gave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {r["doc_id"]: plain_grams(r["text"] or "") for r in rows}
    learned = [counts[r["doc_id"]] for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and counts[r["doc_id"]]]
    df = Counter(b for c in learned for b in c)
    idf = {b: math.log((1 + len(learned)) / (1 + df[b])) + 1 for c in counts.values() if c for b in c}
    assert all(math.isclose(model.idf[b], x, rel_tol=1e-6) for b, x in idf.items())
    got = {r["doc_id"]: r for r in language.op6_language(spark, SF).collect()}
    for r in rows:
        found = got[r["doc_id"]]
        assert found["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        c = counts[r["doc_id"]]
        if c is None:
            assert (found["lang_pred"], found["score"]) == ("und", 0.0)
            continue
        norm = math.sqrt(sum((n * idf[b]) ** 2 for b, n in c.items()))
        # the model keeps idf times weight
        logits = [(sum(n * idf[b] / norm * model.weights[b, k] / idf[b] for b, n in c.items()) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(x - max(logits)) for x in logits]
        best = max(range(len(p)), key=p.__getitem__)
        assert found["lang_pred"] == model.languages[best] and math.isclose(found["score"], p[best] / sum(p), rel_tol=1e-4)


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Hallo  wörld 12 abc! " * 5
    whole = language.gram_counts(text)
    for piece in (1, 2, 3, 5, 16):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (language.gram_counts(text) == whole).all()


def test_ftrl_learns_and_temperature_calibrates():
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(400):
        label = int(rng.integers(0, 2))
        rows.append((np.array([label, 2 + int(rng.integers(0, 5))]), np.array([1.0, 0.5]), label))
    w = language.fit_ftrl(rows, 2, 7, l1=3.0)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[2:7] == 0).any()
    logits = np.array([[8.0, 0.0]] * 100)
    t = language.fit_temperature(logits, np.array([0] * 75 + [1] * 25))
    assert abs(1 / (1 + math.exp(-8 / t)) - 0.75) < 0.01


@pytest.mark.parametrize("op", ["substring_dedup.op3_substring_dedup", "bpe.op5_bpe", "minhash.op7_minhash", "line_dedup.op8_line_dedup"])
def test_empty_tables(spark, empty, op):
    module, name = op.split(".")
    assert getattr(globals()[module], name)(spark, empty).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    for d in (odd, empty):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            if name != "bpe":
                assert out.columns == docs.columns
                out.write.parquet(path := f"{d}/stage-{name}")
                out = spark.read.parquet(path)
            rows = out.collect()
            docs = out
        assert (len(rows) > 0) == (d == odd)


def test_pipeline_by_brute_force(spark):
    """Every stage on its own input: what goes must go, what is clean stays."""
    d = SF
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r[0] for r in stages["language"](spark, docs, d).select("doc_id").collect()}
    assert len(kept) >= 0.99 * docs.count()
    texts = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1]) for r in docs.select("doc_id", "text").collect()}
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    assert {r[0] for r in stages["exact_dedup"](spark, docs, d).select("doc_id").collect()} == set(first.values())
    sets = word_sets([(k, t) for k, t in texts.items()], 5)
    groups, ids = Groups(), sorted(sets)
    for i, a in enumerate(ids):
        groups.find(a)
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    assert {r[0] for r in stages["near_dedup"](spark, docs, d).select("doc_id").collect()} == {k for k in ids if groups.find(k) == k}


def test_pipeline_composed(spark):
    """All five stages together: texts by Python, the mixture by SQL, tokens by the library; only which language is found is taken from the stage."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r[0] for r in corpus_pipeline.identify_language(spark, docs, SF).select("doc_id").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in known}
    first = {}
    for k in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[k]["text"]), k)
    sets = word_sets([(k, rows[k]["text"]) for k in first.values()], 5)
    groups, ids = Groups(), sorted(sets)
    for i, a in enumerate(ids):
        groups.find(a)
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    kept = [rows[k] for k in ids if groups.find(k) == k]
    con = duckdb.connect()
    con.register("kept", pa.table({c: [r[c] for r in kept] for c in ("doc_id", "text", "source")}))
    tokenizer, want = Tokenizer.from_file(bpe.default_path()), Counter()
    for doc_id, copies in con.execute(f"WITH {mixing.mixed_sql('kept')[1:]} SELECT doc_id, copies FROM mixed").fetchall():
        ids = tokenizer.encode(rows[doc_id]["text"], add_special_tokens=False).ids
        want[doc_id, tuple(ids)] += copies
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(got) > 100


def test_line_dedup_broadcasts_nothing(spark, monkeypatch):
    """However small its tables are: none goes through the driver."""
    plans, write = [], line_dedup.durable

    def seen(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name)

    for module in (line_dedup, components, setjoin):
        monkeypatch.setattr(module, "durable", seen)
    monkeypatch.setattr(line_dedup.open_pairs, "__defaults__", (80, 2))  # also bands of many lines
    text = "the quick brown fox jumps over the lazy dog number {}"
    rows = [(i, "\n".join(text.format(n) for n in range(i, i + 3))) for i in range(20)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "id long, text string"))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert out.count() == 60 and sum(p.count("SortMergeJoin") for p in plans) > 20
    assert not [p for p in plans if "BroadcastHashJoin" in p or "NestedLoop" in p]
