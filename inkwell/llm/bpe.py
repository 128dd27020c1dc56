"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each word. A token sequence is what byte-pair merging
gives exactly if every token is stable (merging its own symbols gives it back) and every adjacent pair is
compatible (merging the two tokens' symbols together gives the two tokens back). Both tests run as numpy
operations over all new words of a batch; only words that fail one are merged exactly, rank by rank.

Words repeat, so results are kept per white-space chunk in a bounded cache of each Python worker.

The tokenizer file is a parameter (``word_bpe_49k.json`` of the public tokenizers by default). Supported are
BPE models whose normalizer is made of NFC, white-space folding and lower-casing, and whose words come from one
"removed, inverted" split pattern. Added tokens found in a text are tokens of their own, as in the library.

Edge cases: a null text counts as empty and gives no tokens; an empty table gives an empty table; texts of
any length are encoded whole; repeated rows stay; extra columns are carried along by :func:`encode` and
:func:`decode`, which refuse an output name that is already taken.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

NEVER = np.int64(1) << 40
NO_RULE = 1 << 40
CACHE_CHUNKS = 300_000
#: Texts that are encoded at once.
SLICE = 200
#: White space of the tokenizers' pattern language (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{SPACE}]+")
#: ``str.split`` also cuts at these, which the pattern language counts as ordinary characters.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """A tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec.get("normalizer") or {}
        kinds = {s["type"] for s in steps.get("normalizers", [steps] if steps else [])}
        if model["type"] != "BPE" or not kinds <= {"NFC", "Replace", "Lowercase"} or spec.get("decoder"):
            raise ValueError(f"{path}: not a tokenizer of the supported kind")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: unsupported split")
        self.nfc, self.fold = "NFC" in kinds, "Lowercase" in kinds
        self.words = regex.compile(split["pattern"]["Regex"])
        self.letters = "|[\\p{L}]+|" in f"|{split['pattern']['Regex']}|"  # then a chunk of plain letters is one word
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        size = 1 + max([*self.vocab.values(), *added.values()])
        self.text = [""] * size
        for s, i in (*self.vocab.items(), *added.items()):
            self.text[i] = s
        cut = len(self.end)
        self.trie = ahocorasick.Automaton()
        self.width = np.zeros(size, dtype=np.int64)
        for s, i in self.vocab.items():
            ends = cut and s.endswith(self.end)
            self.trie.add_word(s[:-cut] + "\0" if ends else s, i)
            self.width[i] = len(s) - cut + 1 if ends else len(s)
        self.trie.make_automaton()
        self.symbols = dict(enumerate(byte_symbols()))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rules = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.rank_of = {p: k for p, (k, _) in self.rules.items()}
        self.made = {k: m for k, m in self.rules.values()}
        self._tables(size)
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers: a third of what tuples take
        # a chunk holds no white space, so these keys are free
        self.specials = {" " + s: np.int32(i).tobytes() for s, i in added.items()}
        self._reset()

    def _tables(self, size: int) -> None:
        left, right, rank, made = (np.array(x, dtype=np.int64) for x in zip(*[(a, b, k, m) for (a, b), (k, m) in self.rules.items()], strict=True))
        self.size = size
        order = np.argsort(left * size + right)
        self.pair_keys, self.pair_ranks = (left * size + right)[order], rank[order]
        # base symbols have rank -1; of several rules for one token the earliest counts
        self.rank = np.full(size, -1, dtype=np.int64)
        self.part = np.zeros((2, size), dtype=np.int64)
        for i in np.argsort(-rank):
            self.rank[made[i]], self.part[0, made[i]], self.part[1, made[i]] = rank[i], left[i], right[i]
        self.stable = np.ones(size, dtype=bool)
        built = np.flatnonzero(self.rank >= 0)
        fits = self.compatible(self.part[0, built], self.part[1, built], self.rank[built])
        for i, ok in sorted(zip(built.tolist(), fits.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            self.stable[i] = ok and self.stable[self.part[0, i]] and self.stable[self.part[1, i]]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging would leave each pair apart: no merge across the border before ``limit``.

        Walks back in time: the later of the two tokens' last merges is undone, which shows the pair that met at the
        border before it. A rule that joins that pair earlier than the undone merge speaks against the pair. Of equal rules
        the left place goes first, so a rule as old as the right token's merge speaks against it too.
        """
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER, dtype=np.int64) if limit is None else limit.copy()
        while len(live):
            joins = self.pair_rank(a, b) < limit
            good[live[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~joins & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.part[1, a], a), np.where(undo_left, b, self.part[0, b])
        return good

    def greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens proposed for all words and the index of each token's word: the longest match from the left, over and over."""
        spans = np.cumsum([len(w) + 1 for w in words])
        found = list(self.trie.iter_long("\0".join(words) + "\0"))
        ends = np.fromiter((e for e, _ in found), dtype=np.int64, count=len(found))
        return np.fromiter((t for _, t in found), dtype=np.int64, count=len(found)), np.searchsorted(spans, ends, side="right")

    def merged(self, word: str) -> list[int]:
        """Exact merging: always the rule of lowest rank, leftmost first."""
        ids = [self.vocab[c] for c in word[:-1]]
        ids.append(self.vocab[word[-1] + self.end])
        rank, made = self.rank_of.get, self.made
        found = [rank(p, NO_RULE) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == NO_RULE:
                break
            i = found.index(best)
            ids[i : i + 2] = (made[best],)
            del found[i]
            if i:
                found[i - 1] = rank((ids[i - 1], ids[i]), NO_RULE)
            if i < len(found):
                found[i] = rank((ids[i], ids[i + 1]), NO_RULE)
        return ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Tokens of each word (already in byte symbols), as 32-bit integers."""
        flat, owner = self.greedy(words)
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        covered = np.add.reduceat(self.width[flat], bounds[:-1]) == np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + bool(self.end)  # the end mark too
        wrong = owner[~self.stable[flat]]
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        clash = owner[inside[~self.compatible(flat[inside], flat[inside + 1])]]
        ids, cuts = flat.astype(np.int32).tobytes(), (4 * bounds).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.unique(np.concatenate([wrong, clash, np.flatnonzero(~covered)])).tolist():
            out[i] = array("i", self.merged(words[i])).tobytes()
        return out

    def _reset(self) -> None:
        self.cache.clear()
        self.cache.update(self.specials)

    def _learn(self, chunks: set[str]) -> None:
        symbols, find = self.symbols, self.words.findall
        single, mixed = [], {}
        for c in chunks:
            if self.letters and c.isascii() and c.isalpha():
                single.append(c)
            else:
                mixed[c] = [m if m.isascii() and m.isprintable() else m.encode().decode("latin-1").translate(symbols) for m in find(c)]
        words = list(dict.fromkeys(chain(single, *mixed.values())))
        ids = dict(zip(words, self.encode_words(words), strict=True)) if words else {}
        for c in single:
            self.cache[c] = ids[c]
        for c, found in mixed.items():
            self.cache[c] = ids[found[0]] if len(found) == 1 else b"".join(map(ids.__getitem__, found))

    def chunks(self, text: str) -> list[str]:
        if self.added is not None and self.added.search(text):
            out = []
            for k, piece in enumerate(self.added.split(text)):
                out += [" " + piece] if k % 2 else self.chunks(piece)
            return out
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.fold:
            text = text.replace("Σ", "σ").lower()  # character by character: no final sigma
        return [c for c in _SPLIT.split(text) if c] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        out = []
        for at in range(0, len(texts), SLICE):
            cut = [self.chunks(t) if t else [] for t in texts[at : at + SLICE]]
            if len(self.cache) > CACHE_CHUNKS:
                self._reset()
            if new := set().union(*cut).difference(self.cache):
                self._learn(new)
            get = self.cache.__getitem__
            out += [np.frombuffer(b"".join(map(get, c)), dtype=np.int32) for c in cut]
        return out

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by a space, as the library does for a file without a decoder."""
        text = self.text
        return " ".join([text[i] for i in ids])


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One copy of a tokenizer for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _free(df: DataFrame, *names: str) -> None:
    if taken := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")


def id_lists(bpe: Bpe, texts: pa.Array) -> pa.Array:
    """Token ids of each text, straight into Arrow lists."""
    found = bpe.encode(texts.to_pylist())
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))


def id_batches(batches, bpe: Bpe, at: int, kept: list[int], names: list[str]):
    """The ``kept`` columns of each batch and the ids of column ``at``, ``SLICE`` rows at a time: a batch's ids are never in memory at once, here or in the JVM."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), id_lists(bpe, part.column(at))], names=names)
        batch = part = None
        # Arrow keeps what it freed; the JVM beside needs the executor's memory
        pa.default_memory_pool().release_unused()


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", path: str | None = None, keep: bool = True) -> DataFrame:
    """Add the token ids of ``text`` as ``array<int>``; a null text gives an empty array. Without ``keep`` the text itself is left out."""
    _free(df, out)
    path = path or default_path()
    at = [c.lower() for c in df.columns].index(text.lower())
    kept = [i for i in range(len(df.columns)) if keep or i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = schema.names
    return df.mapInArrow(lambda batches: id_batches(batches, load(path), at, kept, names), schema)


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the decoded text of an id column; null ids give an empty text."""
    _free(df, out)
    path = path or default_path()

    @F.pandas_udf(T.StringType())
    def texts(column):
        import pandas as pd

        bpe = load(path)
        return pd.Series([bpe.decode([] if x is None else list(x)) for x in column], dtype=object)

    return df.withColumn(out, texts(F.col(ids)))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode in one Python pass and return only counts and checksums, so ids cross to the JVM never."""
    path = path or default_path()

    def run(batches):
        bpe, sha, number = load(path), hashlib.sha256, None
        number = [str(i) for i in range(bpe.size)]
        for batch in batches:
            texts = batch.column(1)
            counts, ids_sha, text_sha = [], [], []
            for at in range(0, batch.num_rows, SLICE):
                for packed in bpe.encode(texts.slice(at, SLICE).to_pylist()):
                    ids = packed.tolist()
                    counts.append(len(ids))
                    ids_sha.append(sha(" ".join([number[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_speculate_verify_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_speculate_verify_bpe": op1_speculate_verify_bpe}
ORACLES: dict[str, str] = {}
