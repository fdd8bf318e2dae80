"""Byte-pair encoding and decoding with a public vocabulary.

The vocabulary file (tokenizers' JSON; its path is a parameter) must hold a BPE with the normaliser NFC, blanks to spaces, lower case,
a byte-level alphabet and word ends ``</w>``, as ``word_bpe_49k.json`` does. A word's merges are found without merging:

* An Aho-Corasick automaton over all tokens gives, in one pass, the longest token that starts at each place of the word; a table gives
  the next shorter token that a token begins with.
* Going left to right, the longest token is taken that may follow the one before; where none may, the last token is given up for the
  next shorter one, and the place reached is marked dead, so no place is entered twice and the time is linear in the word.
* Two tokens may be neighbours if no merge would have joined a piece at the end of the first with a piece at the start of the second
  while both existed. Which pairs are compatible is kept in a table, filled as pairs are met.

The one chain of pairwise compatible tokens is what merging by rank gives (every merge joins tokens that earlier merges made;
``Vocabulary`` checks this). Encodings of the short words met last are kept per Python worker (``Recent``). Decoding concatenates the tokens' strings
from one byte string with a table of offsets.

Texts are worked through in pieces of about PIECE characters cut at blanks, so memory doesn't follow the longest text; the columns
travel in Arrow batches, which Spark bounds by bytes.

Defined cases: a null or blank text has no tokens (``n_tokens`` 0, empty id bytes and empty decoded text); repeated rows give a row each;
an empty table gives an empty result; the strings of the special tokens are encoded as those tokens, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CACHE = 150_000  # words of at most LONG characters in each half of a cache
LONG = 48
PAIRS = 250_000  # entries of the compatibility table in a worker
PIECE = 1 << 18
END = "</w>"

MARK = "\ue000"  # stands for END in the automaton; not in the byte alphabet

# fixed values: the blanks of the normaliser's \s and the word pattern of the pre-tokenizer
BLANK = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|(?:(?!" + BLANK + r")[^\p{L}\p{N}])+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 upwards."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return out


class Recent(dict):
    """What ``make`` gives for a word. Words of up to LONG characters are kept, in two halves: when the new one is full, the old one, with all that wasn't asked for since, goes."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Vocabulary:
    """Tokens, merges and the tables made from them. Built once in a Python worker."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder") is not None:
            raise ValueError(f"{path}: a BPE with word ends and without a decoder is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        strings = {i: s for s, i in {**self.ids, **self.special}.items()}
        self.size = max(strings) + 1
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a merged token: rank, left, right
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = self.ids[left], self.ids[right], self.ids[left.removesuffix(END) + right]
            made = all(len(self._bare(x)) == 1 or self.ids[x] in self.parts for x in (left, right))
            if not made or whole in self.parts:
                raise ValueError("every merge must join tokens made before it, and make a token of its own")
            self.rank[a, b] = rank
            self.parts[whole] = (rank, a, b)
        keys = {}
        for s, i in self.ids.items():
            if i in self.parts or len(self._bare(s)) == 1:  # no other token comes out of merging
                key = self._bare(s) + MARK * s.endswith(END)
                keys[key] = (len(key), i)
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, tuple[int, int] | None] = {}  # of a token: length and id of the longest token it begins with
        for key, match in keys.items():
            self.automaton.add_word(key, match)
            self.shorter[match[1]] = next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), None)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.split_words = regex.compile(WORDS).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.split_blanks = regex.compile(BLANK + "+").split
        self.next_blank = regex.compile(BLANK).search
        self.alphabet = dict(enumerate(byte_alphabet()))
        encoded = [strings.get(i, "").encode() for i in range(self.size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(encoded), np.uint8)
        self.words = Recent(self._word)  # encodings of pre-tokenized words
        self.chunks = Recent(self._chunk)  # encodings of what stands between blanks

    @staticmethod
    def _bare(token: str) -> str:
        return token.removesuffix(END)

    # --- encoding ---------------------------------------------------------------------------------------------------------------

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The pieces that stood at the token's right (left) end, each with the rank of the merge that used it up."""
        found = self.edges[right].get(token)
        if found is None:
            found, piece, until = [], token, float("inf")
            while piece is not None:
                found.append((piece, until))
                until, a, b = self.parts.get(piece, (0, None, None))
                piece = b if right else a
            self.edges[right][token] = found
        return found

    def _meet(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as neighbours when both are made from their own characters."""
        rank_of, left = self.rank.get, self._edge(b, False)
        for x, x_until in self._edge(a, True):
            for y, y_until in left:
                rank = rank_of((x, y))
                # of equal ranks the left pair is merged first: y would be taken by x, x by its own left neighbour
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def encode_word(self, word: str) -> list[int]:
        """word: characters of the byte alphabet, without the end mark."""
        n = len(word) + 1
        longest: list[tuple[int, int] | None] = [None] * n
        for end, match in self.automaton.iter(word + MARK):
            longest[end + 1 - match[0]] = match  # a longer one ends later
        table, shorter, dead = self.compatible, self.shorter, bytearray(n + 1)
        tokens, places, at, last, match = [], [], 0, -1, longest[0]
        while at < n:
            while match is not None:
                length, token = match
                if not dead[at + length]:
                    ok = True if last < 0 else table.get((last, token))
                    if ok is None:
                        if len(table) >= PAIRS:
                            table.clear()
                        ok = table[last, token] = self._meet(last, token)
                    if ok:
                        tokens.append(token)
                        places.append(at)
                        at, last = at + length, token
                        match = longest[at] if at < n else None
                        break
                match = shorter[token]
            else:
                if not places:
                    raise ValueError(f"no encoding: {word!r}")
                dead[at] = 1
                at, match = places.pop(), shorter[tokens.pop()]
                last = tokens[-1] if tokens else -1
        return tokens

    def _word(self, word: str) -> bytes:
        mapped = word.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)
        tokens = self.encode_word(mapped)
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def _chunk(self, chunk: str) -> bytes:
        """chunk: characters between blanks, as they stand in the text."""
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk.lower()]
        if not chunk.isascii():
            # each character is lowered by itself: a final sigma becomes a plain one
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.split_words(chunk.lower())))

    def _plain(self, text: str) -> bytes:
        # str.split() has four more blanks than the normaliser
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else filter(None, self.split_blanks(text))
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, piece by piece."""
        for part in self.split_special(text or "") if self.split_special and "<|" in (text or "") else [text or ""]:
            if part in self.special:
                yield np.array([self.special[part]], "<u4").tobytes()
                continue
            at = 0
            while at < len(part):
                blank = self.next_blank(part, at + PIECE)
                end = blank.start() if blank else len(part)
                yield self._plain(part[at:end])
                at = end

    # --- decoding ---------------------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """The tokens' strings in UTF-8, a space before each but the text's first."""
        if not len(ids):
            return b""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths + 1)
        out = np.full(int(ends[-1]), 0x20, np.uint8)
        # where a token's bytes go: behind its space
        shift = np.repeat(starts - (ends - lengths), lengths)
        where = np.flatnonzero(_inside(ends, lengths))
        out[where] = self.bytes[where + shift]
        return out[1:].tobytes() if first else out.tobytes()


def _inside(ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """True for every byte that isn't a separating space."""
    inside = np.ones(int(ends[-1]), bool)
    inside[ends - lengths - 1] = False
    return inside


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_decode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves. ``path``: the vocabulary's place on every executor (None: where the executor's package of public tokenizers has it)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path or default_path())
        for batch in batches:
            counts, encoded_hex, decoded_hex, kept = [], [], [], []
            for value in batch.column(1):
                n, own, ids_hash, text_hash = 0, [], hashlib.sha256(), hashlib.sha256()
                for piece in vocab.encode(value.as_py()):
                    ids_hash.update(piece)
                    numbers = np.frombuffer(piece, "<u4")
                    for at in range(0, len(numbers), PIECE):
                        text_hash.update(vocab.decode(numbers[at : at + PIECE], n + at == 0))
                    n += len(numbers)
                    if ids:
                        own.append(numbers)
                counts.append(n)
                encoded_hex.append(ids_hash.hexdigest())
                decoded_hex.append(text_hash.hexdigest())
                if ids:
                    kept.append(np.concatenate(own).astype(np.int32) if own else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded_hex, pa.string()), pa.array(decoded_hex, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return df.select(key, text).mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
