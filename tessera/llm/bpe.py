"""Byte-pair encoding by batched numpy merge rounds, and the decoding of ids.

A batch of texts is cut at white space; every distinct chunk is encoded once and remembered in a
bounded table, so that a text costs a lookup a word. New words are encoded together: the symbols
of all of them lie in one flat array, every round finds each word's lowest-rank pair by binary
search over the sorted pair keys and merges it everywhere, until no word has a pair left.

Defined cases: a null or empty text has no ids and decodes to the empty string; the strings of
special tokens are recognised anywhere in a text; texts of any length are encoded whole; repeated
rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tessera.llm.common import small, worker_cache

#: What white space is to the tokenizer: str.split() would also cut at 0x1C to 0x1F.
SPACE = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
NO_RANK = np.iinfo(np.int64).max
#: Outside of this Unicode versions and case rules may differ between libraries.
ODD = regex.compile(r"[^\x21-\x7e\xa1-\u024f]")
UNUSUAL = regex.compile(r"[^\t-\r\x20-\x7e\xa1-\u024f]")
#: Chunks in one generation of those that a Python worker remembers: 400 MB for both at most.
REMEMBERED = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.base = max(vocab.values()) + 1
        left, right, made = [], [], []
        for a, b in spec["model"]["merges"]:
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) != 0])  # a pair listed twice keeps its first rank
        order = order[first]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        library = Tokenizer.from_file(path)
        self.normalizer = library.normalizer
        self.splitter = pre_tokenizers.Split(Regex(self.pieces.pattern), "removed", invert=True)

    def rank_pairs(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Set the ranks of the pairs that begin at ``at``, by binary search over the sorted pair keys."""
        rank[at] = NO_RANK
        at = at[at + 1 < len(symbols)]
        at = at[word[at] == word[at + 1]]
        keys = symbols[at] * self.base + symbols[at + 1]
        found = np.searchsorted(self.keys, keys)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == keys
        rank[at[hit]] = self.ranks[found[hit]]

    def words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (UTF-8, none empty) in one array, and where each piece's begin and the last ends."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbols), NO_RANK)  # of the pair that begins at each symbol
        self.rank_pairs(symbols, word, rank, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            over = best == NO_RANK
            if over.any():
                done.append((word[over], symbols[over]))
            where = np.flatnonzero((rank == best) & ~over)
            # of pairs that overlap, as in a run of one symbol, every second one is merged
            if len(where) > 1 and (np.diff(where) == 1).any():
                fresh = np.concatenate([[True], np.diff(where) != 1])
                begun = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - begun) % 2 == 0]
            symbols[where] = self.made[rank[where]]
            keep = ~over
            keep[where + 1] = False
            merged = (np.cumsum(keep) - 1)[where]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            self.rank_pairs(symbols, word, rank, np.concatenate([merged, merged[merged > 0] - 1]))  # no other pair is new
        if not done:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        owner = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])[order := np.argsort(owner, kind="stable")]
        return ids.astype("<u4"), np.searchsorted(owner[order], np.arange(len(pieces) + 1))

    def pieces_of(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [chunk.lower()] if chunk.isalpha() else self.pieces.findall(chunk.lower())
        if not ODD.search(chunk):
            text = chunk.lower()  # these characters are composed already
            return [text] if text.isalpha() else self.pieces.findall(text)
        # beyond common Latin letters the library's own tables say what is a letter
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space; special tokens stand alone, after a space, which no other chunk
        holds: lower-cased, a plain text may spell one. Plain texts are lower-cased whole."""
        if "<|" in text and self.special_at.search(text):
            return [c for i, part in enumerate(self.special_at.split(text)) for c in ([f" {part}"] if i % 2 else self.chunks(part))]
        if text.isascii() and not SEPARATORS.search(text) or not UNUSUAL.search(text):
            return text.lower().split()
        return [c for c in SPACE.split(text) if c]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: this vocabulary's file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str | None) -> np.ndarray:
        known = Remembered(self, Bytes())
        chunks = known.prepare([text])[0]
        return np.frombuffer(b"".join([known.table[c] for c in chunks]), "<u4")


class Form:
    """What is kept of the ids of a chunk."""

    def of_pieces(self, flat: np.ndarray, at: list[int]) -> list:
        raise NotImplementedError

    def joined(self, parts: list):
        raise NotImplementedError


class Bytes(Form):
    """Little-endian unsigned 32-bit ids."""

    def of_pieces(self, flat: np.ndarray, at: list[int]) -> list[bytes]:
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in itertools.pairwise(at)]

    def joined(self, parts: list[bytes]) -> bytes:
        return b"".join(parts)


class Strings(Form):
    """A string for each id, joined by spaces."""

    def __init__(self, names: list[str]):
        self.names = names

    def of_pieces(self, flat: np.ndarray, at: list[int]) -> list[str]:
        all_names = [self.names[i] for i in flat.tolist()]
        return [all_names[a] if b - a == 1 else " ".join(all_names[a:b]) for a, b in itertools.pairwise(at)]

    def joined(self, parts: list[str]) -> str:
        return " ".join(parts)


class Pairs(Form):
    """Two forms of the same ids."""

    def __init__(self, one: Form, two: Form):
        self.one, self.two = one, two

    def of_pieces(self, flat: np.ndarray, at: list[int]) -> list[tuple]:
        return list(zip(self.one.of_pieces(flat, at), self.two.of_pieces(flat, at), strict=True))

    def joined(self, parts: list[tuple]) -> tuple:
        return self.one.joined([p[0] for p in parts]), self.two.joined([p[1] for p in parts])


@functools.lru_cache(maxsize=2)
def model(path: str) -> WordBpe:
    return WordBpe(path)


def id_bytes(path: str) -> "Remembered":
    """One for each Python worker: what a task has met helps the next."""
    return worker_cache(f"bytes {path}", lambda: Remembered(model(path), Bytes()))


def id_and_token_strings(path: str) -> "Remembered":
    def make() -> Remembered:
        bpe = model(path)
        names = [bpe.tokens[i] for i in range(len(bpe.tokens))]
        return Remembered(bpe, Pairs(Strings([str(i) for i in range(len(names))]), Strings(names)))

    return worker_cache(f"strings {path}", make)


class Remembered:
    """Chunks met so far and what ``form`` made of their ids (``table``), in two generations of bounded size."""

    def __init__(self, bpe: WordBpe, form: Form, most: int = REMEMBERED):
        self.bpe, self.form, self.most = bpe, form, most
        self.table: dict = {}  # a plain dict: sets compare with it by lookup
        self.old: dict = {}
        ids = np.array(list(bpe.special.values()), "<u4")
        self.special = dict(zip([f" {name}" for name in bpe.special], form.of_pieces(ids, list(range(len(ids) + 1))), strict=True))

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text; all of them can then be looked up in the table."""
        lists = [self.bpe.chunks(t or "") for t in texts]
        if len(self.table) > self.most:
            self.old = dict(self.table)
            self.table.clear()
        if not self.table:
            self.table.update(self.special)
        # text by text: a text's own words fit the processor's caches, those of all texts do not
        met = set().union(*[set(chunks).difference(self.table) for chunks in lists])
        self.learn(met if not self.old else self.recalled(met))
        return lists

    def recalled(self, chunks: Iterable[str]) -> list[str]:
        """Take what the older generation knows; the rest is new."""
        new = []
        for c in chunks:
            if (known := self.old.get(c)) is None:
                new.append(c)
            else:
                self.table[c] = known
        return new

    def learn(self, chunks: Iterable[str]) -> None:
        """Encode chunks. A piece is a chunk whose only piece it is, so pieces are remembered alike."""
        table = self.table
        cut = {c: self.bpe.pieces_of(c) for c in chunks}
        every = list({p for ps in cut.values() for p in ps}.difference(table))
        flat, at = self.bpe.words([p.encode() for p in every])
        table.update(zip(every, self.form.of_pieces(flat, at.tolist()), strict=True))
        for c, ps in cut.items():
            if len(ps) != 1:
                table[c] = self.form.joined([table[p] for p in ps])
            elif ps[0] != c:
                table[c] = table[ps[0]]


def digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = id_and_token_strings(path)
    sha = hashlib.sha256
    for batch in small(batches):
        counts, one, two = [], [], []
        for chunks in known.prepare(batch.column(1).to_pylist()):
            pairs = [known.table[c] for c in chunks]
            ids = " ".join([p[0] for p in pairs])
            counts.append(ids.count(" ") + 1 if ids else 0)
            one.append(sha(ids.encode()).hexdigest())
            two.append(sha(" ".join([p[1] for p in pairs]).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one narrow pass."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        functools.partial(digests, tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def id_arrays(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = id_bytes(path)
    for batch in small(batches):
        lists = known.prepare(batch.column(1).to_pylist())
        ids = [np.frombuffer(b"".join([known.table[c] for c in chunks]), "<i4") for chunks in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        functools.partial(id_arrays, tokenizer), "doc_id long, ids array<int>"
    )


def texts(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = model(path)
    for batch in small(batches):
        out = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "decoded"])


def decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, decoded of the ids; null ids decode to the empty string."""
    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        functools.partial(texts, tokenizer), "doc_id long, decoded string"
    )
