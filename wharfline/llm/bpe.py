"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition that no earlier batch had are laid out as one array of symbols. An index
maps each mergeable pair to the positions where it occurs. Ranks that are active leave a heap in ascending
order; a rank is applied at all its positions at once, and the lists of the pairs that it touches are updated.
Ids equal those of the ``tokenizers`` library for files with NFC, white-space and lower-case normalisers, a
removing regular-expression split, byte-level symbols and an end-of-word suffix.

Defined results: a null text is an empty text and has no ids; special tokens written in a text become their
own id, as in the library; texts of any length are read whole; a worker's memory of chunks is emptied when it
has more than CACHE entries, which changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Chunks that a Python worker remembers between batches.
CACHE = 1_000_000
#: White space of the tokenizer's patterns; str.split() also takes U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


#: Chunks of more bytes are encoded where they stand; the shorter ones are known by a 64-bit hash.
LONG_CHUNK = 48
#: Bytes of text that are cut into chunks at once.
WINDOW = 1 << 19
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, for at least n places."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[0] = _powers(BASE, max(n, WINDOW * 2)), _powers(INVERSE, max(n, WINDOW * 2))
    return _POWERS[0]


def _classes() -> np.ndarray:
    """1 for ASCII letters, 2 for ASCII marks that never share a pre-token or special token with a letter, else 0."""
    kind = np.zeros(256, np.int8)
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = 2
    return kind


KIND = _classes()
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the chunks of a buffer that ends with white space.

    Chunks end at ASCII white space and where an ASCII letter and an ASCII mark meet; no pre-token crosses these.
    """
    space, kind = ASCII_SPACE[data], KIND[data]
    inside = ~space
    meet = (kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)
    start = np.flatnonzero(inside & np.append(True, space[:-1] | meet)) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside[:-1] & (space[1:] | meet)) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return start, end, (total[end] - total[start]) * down[start]


class PairIndexBPE:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or len(self.vocab) + len(self.special) > 65536:
            raise ValueError(f"{path}: only BPE files with NFC, white-space and lower-case normalisers and 16-bit ids are supported")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([self.vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([self.vocab.get(s + self.suffix, -1) for s in symbols], np.int64)
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        pairs, made = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append(self.vocab[a] * self.size + self.vocab[b])
            made.append(self.vocab[a + b])
        pairs = np.array(pairs, np.int64)
        self.made = np.array(made, np.int64)
        order = np.argsort(pairs, kind="stable")
        self.sorted_pairs, self.sorted_ranks = np.append(pairs[order], np.iinfo(np.int64).max), np.append(order, -1)
        self.tokens = [b""] * self.size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self.forget()

    def forget(self) -> None:
        """Empty the memory of chunks: an open hash table of their hashes, and where their ids lie in the pool."""
        self.slots, self.bits = np.full(1 << 20, -1, np.int32), 20
        self.known, self.place, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Number of each chunk among the known ones, -1 for the others."""
        slot = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[slot]
        open_ = np.flatnonzero((out >= 0) & (self.known[out] != hashed)) if len(self.known) else np.zeros(0, np.int64)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slots[slot[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.known[got] != hashed[open_])]
        return out

    # ---- the pair occurrence index

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair has none."""
        key = left * self.size + right
        at = self.sorted_pairs.searchsorted(key)
        return np.where(self.sorted_pairs[at] == key, self.sorted_ranks[at], -1)

    @staticmethod
    def _enter(index: dict, heap: list, ranks: np.ndarray, at: np.ndarray) -> None:
        ok = ranks >= 0
        ranks, at = ranks[ok], at[ok]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, i, j in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
            if rank in index:
                index[rank].append(at[i:j])
            else:
                index[rank] = [at[i:j]]
                heapq.heappush(heap, rank)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, as 16-bit little-endian bytes."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum(length)
        symbol = self.inner[data]
        last = np.zeros(len(data), bool)
        last[end[length > 0] - 1] = True
        symbol[last] = self.final[data[last]]
        n = len(symbol)
        following = np.arange(1, n + 1)
        following[last] = n  # n: none
        preceding = np.arange(-1, n - 1)
        preceding[(end - length)[length > 0]] = -1
        alive = np.ones(n + 1, bool)
        alive[n] = False
        symbol = np.append(symbol, -1)
        following = np.append(following, n)
        preceding = np.append(preceding, -1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        at = np.flatnonzero(~last)
        self._enter(index, heap, self._ranks(symbol[at], symbol[at + 1]), at)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = np.sort(np.concatenate(lists))
            at = at[np.append(True, at[1:] != at[:-1]) & alive[at]]
            second = following[at]
            at, second = at[second < n], second[second < n]
            still = self._ranks(symbol[at], symbol[second]) == rank
            at, second = at[still], second[still]
            if (touch := at[1:] == second[:-1]).any():  # of occurrences that overlap (a a a) the left ones are taken
                keep = np.ones(len(at), bool)
                for i in (np.flatnonzero(touch) + 1).tolist():
                    keep[i] = not keep[i - 1]
                at, second = at[keep], second[keep]
            if not len(at):
                continue
            symbol[at] = self.made[rank]
            alive[second] = False
            after = following[second]
            following[at] = after
            inside = after < n
            preceding[after[inside]] = at[inside]
            before = preceding[at]
            has = before >= 0
            left, right = before[has], at[inside]
            self._enter(
                index, heap,
                np.concatenate([self._ranks(symbol[left], symbol[at[has]]), self._ranks(symbol[right], symbol[after[inside]])]),
                np.concatenate([left, right]),
            )
        kept = alive[:n] & (symbol[:n] >= 0)
        ids = symbol[:n][kept].astype("<u2")
        total = np.concatenate([[0], np.cumsum(kept)])
        stop = (total[end] * 2).tolist()
        start = (total[end - length] * 2).tolist()
        flat = ids.tobytes()
        return [flat[i:j] for i, j in zip(start, stop, strict=True)]

    # ---- texts

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space."""
        low = chunk.lower() if "Σ" not in chunk else chunk.replace("Σ", "σ").lower()
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in ".,;:!?|":
            return [low[:-1], low[-1]]
        return self.word.findall(low)

    def _chunk(self, chunk: str) -> list[str | int]:
        """Pre-tokens, and ids of special tokens, of a chunk that may hold white space outside ASCII."""
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0300") and "\u0130" not in chunk:
            return [chunk.lower()]
        if chunk.isascii() and "<|" not in chunk and not ODD_SPACE.search(chunk):
            return self._pieces(chunk)
        out: list[str | int] = []
        for part in self.specials.split(chunk) if self.specials is not None and "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for c in SPACE.split(unicodedata.normalize("NFC", part)):
                    if c:
                        out += self._pieces(c)
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        new = [self._chunk(c) for c in chunks]
        distinct = list({w for ws in new for w in ws if type(w) is str})
        word = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [word[ws[0]] if len(ws) == 1 and type(ws[0]) is str else b"".join([word[w] if type(w) is str else w.to_bytes(2, "little") for w in ws]) for ws in new]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the unsigned 16-bit ids of all whole texts, and where those of each text begin and end."""
        if len(self.known) > CACHE:
            self.forget()
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        windows: list[tuple] = []
        fresh: dict[int, bytes] = {}  # hash of a chunk that is not known yet
        long: list[bytes] = []
        i = 0
        while i < len(raw):
            j, size = i, 0
            while j < len(raw) and (j == i or size + len(raw[j]) < WINDOW):
                size += len(raw[j]) + 1
                j += 1
            joined = b"\n".join(raw[i:j]) + b"\n"
            ends = np.cumsum([len(x) + 1 for x in raw[i:j]])
            data = np.frombuffer(joined, np.uint8)
            if b"<|" not in joined and b"\xcc" not in joined:  # special tokens and combining marks need the case
                data = TO_LOWER[data]
                joined = data.tobytes()
            start, end, hashed = cut(data)
            wide = np.flatnonzero(end - start > LONG_CHUNK)
            long += [joined[s:e] for s, e in zip(start[wide].tolist(), end[wide].tolist(), strict=True)]
            which = self.find(hashed)
            which[wide] = 0
            missed = np.flatnonzero(which < 0)
            order = np.argsort(hashed[missed])
            distinct = hashed[missed[order]]
            new = np.append(True, distinct[1:] != distinct[:-1])[: len(distinct)]
            distinct, first = distinct[new], missed[order[new]]
            for h, s, e in zip(distinct.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
                if h not in fresh:
                    fresh[h] = joined[s:e]
            windows.append((np.searchsorted(start, ends), which, missed, hashed[missed], wide))
            i = j
        if fresh:
            self._remember(fresh)
        wides = iter(self.encode_chunks([b.decode() for b in long]))
        parts, sizes = [], [np.zeros(1, np.int64)]
        for bounds, which, missed, hashed, wide in windows:
            which[missed] = self.find(hashed)
            place, length, pool = self.place[which], self.length[which], self.pool
            if len(wide):
                own = [np.frombuffer(next(wides), "<u2") for _ in range(len(wide))]
                place[wide] = len(pool) + np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]])
                length[wide] = [len(x) for x in own]
                pool = np.concatenate([pool, *own])
            before = np.concatenate([[0], np.cumsum(length)])
            parts.append(pool[np.repeat(place - before[:-1], length) + np.arange(before[-1])])
            sizes.append(np.diff(before[bounds], prepend=0))
        return np.concatenate([np.zeros(0, np.uint16), *parts]), np.cumsum(np.concatenate(sizes))

    def _remember(self, fresh: dict[int, bytes]) -> None:
        ids = self.encode_chunks([b.decode() for b in fresh.values()])
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        new = np.fromiter(fresh, np.uint64, len(fresh))
        number = len(self.known) + np.arange(len(new), dtype=np.int32)
        self.place = np.concatenate([self.place, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u2")])
        self.known = np.concatenate([self.known, new])
        if 3 * len(self.known) > len(self.slots):  # at most a third of the slots are taken
            self.bits = int(3 * len(self.known)).bit_length() + 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            new, number = self.known, np.arange(len(self.known), dtype=np.int32)
        slot, left = (new >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(new))
        while len(left):
            free = self.slots[slot[left]] < 0
            self.slots[slot[left[free]]] = number[left[free]]
            left = left[self.slots[slot[left]] != number[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's decode(ids, skip_special_tokens=False) of a file without decoder, in UTF-8."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str, PairIndexBPE] = {}


def load(path: str | None = None) -> PairIndexBPE:
    """The tokenizer of ``path``, once in each Python process."""
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def in_batches(frames: Iterator[pd.DataFrame], chars: int = 12_000_000) -> Iterator[pd.DataFrame]:
    """Arrow batches joined to about so many characters, so that the index is built over many words at once."""
    held, size = [], 0
    for f in frames:
        held.append(f)
        size += int(f["text"].str.len().fillna(0).sum())
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the ids of every whole text as 32-bit little-endian bytes. Other columns of ``docs`` are not read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for f in in_batches(frames):
            ids, at = bpe.encode_batch(f["text"].tolist())
            ids, at = ids.astype("<u4"), at.tolist()
            yield pd.DataFrame({"id": f["id"], "ids": [ids[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]})

    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, text) from the rows that :func:`encode` returns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "text": [bpe.decode(np.frombuffer(b, "<u4")).decode() for b in f["ids"]]})

    ship(encoded.sparkSession)
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode what was encoded, in one pass over the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for f in in_batches(frames):
            n, a, b = [], [], []
            flat, at = bpe.encode_batch(f["text"].tolist())
            for i, j in zip(at.tolist(), at[1:].tolist(), strict=False):
                ids = flat[i:j]
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pd.DataFrame({"id": f["id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInPandas(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
