"""Byte-pair encoding and decoding with exact results on very long texts.

A text is cut at its special tokens, and where its pre-tokenizer must cut: between a character that
is not white space and one that is.  Such segments repeat, so their ids are kept in a bounded table
per Python worker.  A segment longer than LEAF has no cut (long unsplit text): its halves are encoded
separately, down to leaves, and joined pairwise: a growing window around the join is encoded again
until it agrees with both sides.  Agreement at a shared token proves the join: in byte-pair encoding,
a sequence of tokens is the encoding of its text exactly if each neighbouring pair is.  All leaves of
a segment, and all windows of one level of joins, are one batch each, which the library's threads
encode in parallel where it is long enough to pay for them.

Defined results: null texts count as empty (no ids); repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import claim, map_rows, table, texts, threads, tokenizer

LEAF = 2048
#: Segments kept per worker; the table is emptied when full, which bounds its memory.
KEPT = 400_000
#: Segments encoded as one text when they are learned.
CHAIN = 256
#: Strings in a batch from which its encoding is spread over threads.
THREADED = 64
#: Unicode's white space, as the pre-tokenizer's \\s has it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+\\Z")
_OUTSIDE = re.compile(f"^[{_SPACE}].*[^{_SPACE}]$", re.S)


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: byte-level vocabularies write each byte as one printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    tok = tokenizer(path)
    special = {i: t.content.encode() for i, t in tok.get_added_tokens_decoder().items()}
    return [special[i] if i in special else bytes(to_byte[c] for c in tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())]


def _edges(text: bytes, left: Sequence[int], right: Sequence[int], at: int, size: Sequence[bytes], n: int) -> tuple[int, int, int, int]:
    """Tokens i of the left and j of the right side, and bytes start and end, that bound a window of
    about n tokens on each side of byte `at`; its edges are character boundaries."""
    i, start = len(left), at
    while i and (len(left) - i < n or (text[start] & 0xC0) == 0x80):
        i -= 1
        start -= len(size[left[i]])
    j, end = 0, at
    while j < len(right) and (j < n or (end < len(text) and (text[end] & 0xC0) == 0x80)):
        end += len(size[right[j]])
        j += 1
    return i, start, j, end


def _join(pairs: list[tuple[bytes, list[int], list[int], int]], size: Sequence[bytes], encode_batch: Callable[[list[str]], list[list[int]]]) -> list[list[int]]:
    """Joins (text, ids left of byte `at`, ids right of it, at); the windows that still disagree grow
    and are encoded again, all in one batch."""
    out: list[list[int]] = [[] for _ in pairs]
    todo, n = list(range(len(pairs))), 4
    while todo:
        edges = [_edges(*pairs[k], size, n) for k in todo]
        got = encode_batch([pairs[k][0][e[1] : e[3]].decode() for k, e in zip(todo, edges, strict=True)])
        later = []
        for k, (i, _, j, _), new in zip(todo, edges, got, strict=True):
            _, left, right, _ = pairs[k]
            ok_left = i == 0 or (len(new) > 1 and new[0] == left[i])
            ok_right = j == len(right) or (len(new) > 1 and new[-1] == right[j - 1])
            if ok_left and ok_right:
                out[k] = [*left[:i], *new, *right[j:]]
            else:
                later.append(k)
        todo, n = later, 2 * n
    return out


def encode_tree(text: str, encode_batch: Callable[[list[str]], list[list[int]]], size: Sequence[bytes], leaf: int = LEAF) -> list[int]:
    """Ids of one unsplit text: leaves in one batch, then the joins of each level in one."""
    cuts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    parts = list(zip([c.encode() for c in cuts], encode_batch(cuts), strict=True))
    while len(parts) > 1:
        pairs = [(a + b, x, y, len(a)) for (a, x), (b, y) in zip(parts[::2], parts[1::2], strict=False)]
        rest = parts[2 * len(pairs) :]
        parts = [(p[0], ids) for p, ids in zip(pairs, _join(pairs, size, encode_batch), strict=True)] + rest
    return parts[0][1]


class Encoder:
    """Exact ids of whole texts by segments."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.tok, self.size, self.leaf = tokenizer(path), token_bytes(path), leaf
        special = self.tok.get_added_tokens_decoder()
        # Special tokens that take white space beside them, or parts of words, are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in special.values())
        self.special = {t.content: [i] for i, t in special.items()}
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(longest) + ")") if longest else None
        self.lengths = np.array([len(b) for b in self.size])
        self.kept: dict[str, list[int]] = {}

    def batch(self, texts: list[str]) -> list[list[int]]:
        with threads(len(texts) >= THREADED and sum(map(len, texts)) >= THREADED * LEAF // 2):
            return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> list[int]:
        """Ids of text without cuts."""
        return self.batch([text])[0] if len(text) <= self.leaf else encode_tree(text, self.batch, self.size, self.leaf)

    def learn(self, segments: set[str]) -> None:
        new = [s for s in segments if s not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(segments)
        # Segments that begin with white space and end without it stay separate when written one after
        # the other, so many are encoded as one text and told apart by their lengths in bytes.
        chain = [s for s in new if len(s) <= 64 and _OUTSIDE.match(s)]
        groups = [chain[i : i + CHAIN] for i in range(0, len(chain), CHAIN)]
        for group, ids in zip(groups, self.batch(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(s.encode()) for s in group])) + 1
            at = 0
            for s, cut in zip(group, cuts.tolist(), strict=True):
                self.kept[s] = ids[at:cut]
                at = cut
        chained = set(chain)
        short = [s for s in new if len(s) <= self.leaf and s not in chained]
        for s, ids in zip(short, self.batch(short), strict=True):
            self.kept[s] = ids
        for s in new:
            if len(s) > self.leaf:
                self.kept[s] = self.whole(s)

    def ids(self, text: str) -> list[int]:
        """Equal to the library's encode(text, add_special_tokens=False).ids."""
        if self.cut is None or not self.cut.search(text):
            return self._ids(text)
        if not self.plain:
            return self.batch([text])[0]
        out: list[int] = []
        for part in self.cut.split(text):
            out += self.special[part] if part in self.special else self._ids(part)
        return out

    def _ids(self, text: str) -> list[int]:
        claim(self.kept)
        parts = _SEGMENT.findall(text)
        self.learn(set(parts))
        out: list[int] = []
        for p in map(self.kept.__getitem__, parts):
            out += p
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Equal to the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.size.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str = "byte_bpe_50k.json", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids (array of int) and the text decoded from them."""

    def run(b: dict[str, list]) -> dict[str, list]:
        e = encoder(path)
        ids = [e.ids(t) for t in b["text"]]
        return {id_col: b[id_col], "ids": ids, "decoded": [e.decode(x) for x in ids]}

    return map_rows(texts(docs, id_col, text=text), run, f"{id_col} long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str = "byte_bpe_50k.json") -> DataFrame:
    def run(b: dict[str, list]) -> dict[str, list]:
        e = encoder(path)
        out: dict[str, list] = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in b["text"]:
            ids = e.ids(t)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        return out

    return map_rows(texts(docs, "doc_id"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
