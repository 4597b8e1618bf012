"""Rank-synchronous byte-pair merging over ragged numpy arrays, for vocabularies in the tokenizers library's JSON form.

A batch of pre-tokens is one flat symbol array with a row number for each symbol. In each round every row applies its own
lowest-ranked pair, all of that pair's occurrences at once (left to right where they overlap), until no row has a pair left.
As every merge makes a symbol that no earlier rank can contain, this gives the same symbols as one merge at a time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex
from .common import RELEASE

#: From this character on, letters differ between Unicode versions, so the library's own splitter cuts such chunks.
NEWER_LEAD = "\u0500".encode()[0]
NONE = np.iinfo(np.int32).max
#: The tokenizer's own splitting pattern with its class of white space written out (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|"
WIDE = regex.compile(rf"\n|{CUTS}[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII = re.compile(rb"\n|" + CUTS.encode() + rb"[a-z]+|[0-9]|[^a-z0-9\n]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free code from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Lower-casing byte-level BPE with word-end symbols.

    ``chunks`` are maximal runs without ASCII white space; a chunk's tokens don't depend on its neighbours, so they are kept in
    a young and an old table of at most ``keep`` chunks together: when the young one has half of them it becomes the old one, from
    which chunks that come again move back.
    """

    def __init__(self, path: str, keep: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.path, self.byte_of = path, {x: b for b, x in enumerate(letters)}
        self.mid = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = np.int64(max(vocab.values()) + 1)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)).encode().decode() + ")") if self.special else None
        self.mark = next(iter(self.special))[:2].encode() if self.special else None
        top = max([int(self.base) - 1, *self.special.values()])
        self.dtype = np.dtype("<u2") if top < (1 << 16) - 1 else np.dtype("<u4")
        self._hash_pairs(np.array([vocab[a] for a, _ in pairs], np.int64) * self.base + np.array([vocab[b] for _, b in pairs], np.int64))
        self.keep, self.ids, self.old = keep, {}, {}

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """An open-addressed table: pair -> rank."""
        self.shift = 64 - 19
        self.slots = np.full((1 << 19) + 64, -1, np.int64)
        self.ranks = np.full(len(self.slots), NONE, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        self.probes = 0
        while len(left):
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.slots[at[put]], self.ranks[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], at[rest] + 1
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] += 1
            got = self.slots[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merge(self, seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all sequences (none empty), flat, and how many each has."""
        lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
        flat = np.frombuffer(b"".join(seqs), np.uint8)
        sym, ends = self.mid[flat], np.cumsum(lens) - 1
        sym[ends] = self.last[flat[ends]]
        row = np.repeat(np.arange(len(seqs)), lens)
        done_row, done_sym = [], []
        while len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            many = np.diff(np.append(first, len(row)))
            rank = np.full(len(row), NONE, np.int32)
            inner = np.flatnonzero(row[1:] == row[:-1])
            rank[inner] = self.rank(sym[inner] * self.base + sym[inner + 1])
            low = np.repeat(np.minimum.reduceat(rank, first), many)
            live = low < NONE
            if not live.all():
                done_row.append(row[~live])
                done_sym.append(sym[~live])
                row, sym, rank, low = row[live], sym[live], rank[live], low[live]
                if not len(row):
                    break
            hit = rank == low
            if (hit[1:] & hit[:-1]).any():
                at = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), at, 0))
                hit &= (at - start) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            row, sym = row[stay], sym[stay]
        row, sym = np.concatenate(done_row or [row]), np.concatenate(done_sym or [sym])
        order = np.argsort(row, kind="stable")
        return sym[order], np.bincount(row, minlength=len(seqs))

    @cached_property
    def library(self):
        """The library's own splitter, loaded when a chunk first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def odd(self, chunk: bytes) -> list:
        """Pre-tokens, as bytes, of a chunk with special tokens (as ids) or newer letters."""
        out = []
        for k, part in enumerate(self.special_at.split(chunk.decode("utf-8", "replace")) if self.special_at else [chunk.decode("utf-8", "replace")]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                low = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Put the tokens of ``chunks``, which are new to the table, into it: bytes of ids in ``dtype``.

        All chunks of a kind are split by one search over their lines; a mark that is no id stands for each line's end.
        """
        new = list(chunks)
        plain, wide, odd = [], [], []
        for c in new:
            if self.mark is not None and self.mark in c:
                odd.append(c)
            elif c.isascii():
                plain.append(c)
            elif max(c) >= NEWER_LEAD:
                odd.append(c)
            else:
                wide.append(c)
        split = {c: self.odd(c) for c in odd}
        found = [ASCII.findall(b"\n".join(plain).lower())] if plain else []
        if wide:
            text = unicodedata.normalize("NFC", b"\n".join(wide).decode("utf-8", "replace"))
            found.append([x.encode() for x in WIDE.findall(text.replace("Σ", "σ").lower())])
        words = list(set().union(*found, *([p for p in ps if type(p) is bytes] for ps in split.values())) - {b"\n"})
        end = np.array([np.iinfo(self.dtype).max], self.dtype)
        known = {b"\n": end.tobytes()}
        if words:
            flat, many = self.merge(words)
            raw, size = flat.astype(self.dtype).tobytes(), self.dtype.itemsize
            ends = (np.cumsum(many) * size).tolist()
            known.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        for tokens, of in zip(found, [x for x in (plain, wide) if x]):
            raw = b"".join(map(known.__getitem__, tokens))
            ends = np.flatnonzero(np.frombuffer(raw, self.dtype) == end[0]) * self.dtype.itemsize
            starts = [0, *(ends + self.dtype.itemsize).tolist()]
            self.ids.update(zip(of, map(raw.__getitem__, map(slice, starts, [*ends.tolist(), len(raw)]))))
        for c, ps in split.items():
            self.ids[c] = b"".join(known[p] if type(p) is bytes else np.array([p], self.dtype).tobytes() for p in ps)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes in ``dtype``. The texts are split and looked up as one list, in which a byte that no
        UTF-8 text has stands between two texts."""
        if not texts:
            return []
        clean = [t if b"\xff" not in t else t.decode("utf-8", "replace").encode() for t in texts]
        words = b" \xff ".join(clean).split()
        end = np.array([np.iinfo(self.dtype).max], self.dtype)
        self.ids[b"\xff"] = end.tobytes()
        ids = list(map(self.ids.get, words))
        unknown = [k for k, x in enumerate(ids) if x is None]
        if unknown:
            missing = {words[k] for k in unknown}
            back = missing & self.old.keys()
            self.ids.update(zip(back, map(self.old.__getitem__, back)))
            self.learn(missing - back)
            for k in unknown:
                ids[k] = self.ids[words[k]]
            if 2 * len(self.ids) > self.keep:
                self.ids, self.old = {}, self.ids
        raw = b"".join(ids)
        ends = np.flatnonzero(np.frombuffer(raw, self.dtype) == end[0]) * self.dtype.itemsize
        return [raw[a:b] for a, b in zip([0, *(ends + self.dtype.itemsize).tolist()], [*ends.tolist(), len(raw)])]

    def lengths(self, texts: list[bytes]) -> list[int]:
        return [len(x) // self.dtype.itemsize for x in self.encode(texts)]


@lru_cache(maxsize=2)
def word_bpe(path: str, keep: int = 800_000) -> WordBpe:
    """One instance for each Python worker, vocabulary and size of its tables."""
    return WordBpe(path, keep)


RELEASE.append(word_bpe.cache_clear)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
