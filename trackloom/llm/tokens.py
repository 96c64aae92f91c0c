"""Token ids of whole texts, with the tokenizer run once for each distinct pre-token that a worker meets.

A byte-level BPE never merges across its pre-tokens, so the ids of a text are those of its pre-tokens in order. The
pre-tokens of a slab are found and hashed with numpy; only those not met before are encoded. Where the file's merges
stand in the order of their ids, its vocabulary is a rank table, and tiktoken merges by it several times as fast;
otherwise the tokenizers library does. A text that holds the string of one of the file's added tokens is encoded by the
library as a whole, and so is every text if the file has a normalizer or another way to split than the byte-level one.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from trackloom.llm import text as tx

#: Classes of code points in the pre-token rule.
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a pre-token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: A worker starts its cache of pre-tokens anew beyond so many; results don't depend on it.
CACHE = 1_500_000

_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for code in range(0x110000):
            kind = unicodedata.category(chr(code))[0]
            if kind == "L":
                kinds[code] = LETTER
            elif kind == "N":
                kinds[code] = NUMBER
        kinds[WHITE_SPACE] = BLANK
        _CLASSES = kinds
    return _CLASSES


def pretokens(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the joined code points of rows that start at offsets.

    A pre-token is an apostrophe with a contraction; or a run of letters, of numbers or of other ink, with one blank
    before it if there is one; or a run of white space, which leaves its last one to what follows.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    begin = fresh[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    ink = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~fresh[1:-1]) + 1
    begin[ink - 1] = True
    begin[ink] = codes[ink - 1] != 0x20
    quote = np.flatnonzero((codes == 0x27) & begin)
    for tail in CONTRACTIONS:
        at = quote[quote + len(tail) < n]
        hit = np.ones(len(at), bool)
        for k, letter in enumerate(tail, 1):
            hit &= (codes[at + k] == ord(letter)) & ~fresh[at + k]
        at = at[hit]
        begin[at + 1] = False
        after = at + 1 + len(tail)
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


def ranks(path: str) -> dict[bytes, int] | None:
    """Bytes to ids of a tokenizers file whose merges are in the order of their ids; None for any other."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    back = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = model["vocab"]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocab.get(m, -1) for m in joined]
    if model["type"] != "BPE" or any(a >= b for a, b in zip(order, order[1:], strict=False)) or any(c not in back for w in vocab for c in w):
        return None
    found = {bytes(back[c] for c in w): i for w, i in vocab.items()}
    return found if len(found) == len(joined) + 256 else None


def _byte_level(model: dict) -> bool:
    """Whether a tokenizers file splits texts by the rule of pretokens()."""
    split = model.get("pre_tokenizer") or {}
    return model.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)


class Encoder:
    """Ids of rows of text by a tokenizers file, without those that it adds around a text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.added = [t["content"] for t in model.get("added_tokens") or [] if t["content"]]
        self.whole = not _byte_level(model)  # nothing is known of how it splits texts
        del model
        self.merge = None
        if (table := ranks(path)) is not None:
            import tiktoken

            self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})._encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, strings: list[str]) -> None:
        """hashes: ascending and new."""
        found = list(map(self.merge, strings)) if self.merge else [x.ids for x in self.tokenizer.encode_batch(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])
        where = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, hashes), (self.at, at), (self.size, size)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of the rows of a slab, and each row's number of ids."""
        body = data.tobytes()
        special = sorted(set(range(len(offsets) - 1)) if self.whole else self._with_added(body, offsets))
        if not special:
            return self._encode(body, offsets)
        plain = np.setdiff1d(np.arange(len(offsets) - 1), special)
        ends = np.cumsum([0, *(int(offsets[k + 1] - offsets[k]) for k in plain)])
        ids, sizes = self._encode(b"".join(body[offsets[k] : offsets[k + 1]] for k in plain), ends)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        for k, own in zip(plain, np.split(ids, np.cumsum(sizes)[:-1]) if len(plain) else [], strict=True):
            out[k] = own
        for k in special:
            out[k] = np.array(self.tokenizer.encode(body[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _with_added(self, body: bytes, offsets: np.ndarray) -> set[int]:
        """Rows that hold the string of an added token."""
        found = set()
        for token in self.added:
            raw = token.encode()
            at = body.find(raw)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(raw) <= offsets[row + 1]:
                    found.add(row)
                at = body.find(raw, at + 1)
        return found

    def _encode(self, body: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, data = len(offsets) - 1, np.frombuffer(body, np.uint8)
        text = body.decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        start = pretokens(codes, points)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        end = np.append(start[1:], len(codes))
        hashes = tx.range_hash(tx.prefix_hash(tx.mix(codes.astype(np.uint64) + np.uint64(1))), start, end)
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._forget()
        where = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        new = np.ones(len(own), bool) if not len(self.keys) else self.keys[where] != own
        if new.any():
            self._learn(own[new], [text[start[i] : end[i]] for i in first[new]])
            where = np.searchsorted(self.keys, own)
        at, size = self.at[where][inverse], self.size[where][inverse]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(start, points)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_rows(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of the pieces of rows of given sizes: most each, but a first one may be shorter."""
    count = -(-sizes // most)
    row = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    head = sizes[row] - (count[row] - 1) * most
    start = np.where(piece == 0, 0, head + (piece - 1) * most)
    return row, piece, start, np.where(piece == 0, head, most)


def pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to batches of (doc_id, piece, start, length, ids as little-endian 32-bit numbers)."""
    enc = encoder(path)
    for batch in batches:
        doc_id, column = batch.column(0), batch.column(1)
        for low, high, data, offsets in tx.slabs(column):
            ids, sizes = enc.encode(data, offsets)
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u4")
            sizes = sizes + 1
            row, piece, start, length = cut_rows(sizes, most)
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            kind = pa.large_binary() if ends[-1] >= 1 << 31 else pa.binary()
            body = pa.Array.from_buffers(kind, len(row), [None, pa.py_buffer(ends.astype(np.int64 if kind == pa.large_binary() else np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [doc_id.slice(low, high - low).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), body.cast(pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
