"""Token ids of whole texts through a span cache.

For tokenizers that never join text over white space a text is cut into spans
that are encoded independently: chunks between blanks; and, if the normaliser
lower-cases and the splitter takes runs of letters, single digits and runs of
other signs apart, these runs inside chunks of Latin letters, digits and plain
signs. Chunks with anything else (other scripts, combining marks, quotes, the
characters of special tokens) stay whole and go through the full tokenizer.

Spans are found, folded to lower case and hashed over byte arrays; ids of known
spans come from a hash table in arrays, and only new ones reach the tokenizer. A
span is known by 64 bits of hash.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from readloom.llm import hashing as H

SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
MOST = 1_000_000  # spans that a worker keeps
_SPACE, _LETTER, _SIGN, _DIGIT, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = _SIGN


class SpanTable:
    """Hash to token ids, in arrays; linear probing."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(SLOTS, H.U64), np.zeros(SLOTS, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 20, self.dtype), 0, 0
        self.at, self.size = np.zeros(MOST + 1, np.int64), np.zeros(MOST + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        slot = (keys >> H.U64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New distinct keys with their ids one after the other."""
        if self.used + len(ids) > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + len(ids)), self.dtype)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(ids)] = ids
        entry = np.arange(self.n, self.n + len(keys))
        self.at[entry] = self.used + np.cumsum(size) - size
        self.size[entry] = size
        self.used, self.n = self.used + len(ids), self.n + len(keys)
        todo, slot = np.arange(len(keys)), (keys >> H.U64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])
            self.place[slot[won]] = entry[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (SLOTS - 1)


class Encoder:
    def __init__(self, path: str, by_chunk: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.bare, self.by_chunk = Tokenizer.from_file(path), None, by_chunk
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tok.to_str())
        steps = [[x["type"] for x in (spec[k] or {}).get(v, [])] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        runs = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if by_chunk and steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "").endswith(runs):
            # Lower-case Latin letters pass the normaliser unchanged and are one run of the splitter.
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = SpanTable(self.dtype) if by_chunk else None

    def _ids(self, tok, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(size.sum())), size

    def encode(self, texts: pa.Array, end_id: int) -> list[pa.Array]:
        """Binary arrays of ids (end_id last), together one value for each text."""
        if not self.by_chunk:
            out = []
            for t in texts.to_pylist():
                ids, _ = self._ids(self.tok, [t or ""])
                out.append(ids.tobytes() + np.array([end_id], self.dtype).tobytes())
            return [pa.array(out, pa.binary())]
        return [self._step(w, end_id) for w in H.steps(texts)]

    def _spans(self, w: H.Words) -> tuple[np.ndarray, ...]:
        """Folded bytes, span starts and ends, and whether the bare tokenizer takes them."""
        data, n = w.data, len(w.data)
        if self.bare is None:
            return data, w.starts, w.ends, np.zeros(len(w.starts), bool)
        kind = _CLASS[data]
        fold = H._LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        after = data[lead + 1]
        latin = lead[(after >= 0x80) & (after != 0x97) & (after != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        upper = latin[data[latin + 1] <= 0x9E] + 1
        fold[upper] += 0x20
        odd = np.maximum.reduceat(kind == _OTHER, w.starts) if len(w.starts) else np.zeros(0, bool)
        # A letter byte of an odd chunk may begin or end with it; such chunks stay whole and unfolded.
        size = w.ends - w.starts
        here = np.zeros(n + 1, np.int8)
        here[w.starts[odd]] += 1
        np.add.at(here, w.ends[odd], -1)
        whole = np.cumsum(here[:n]).astype(bool)
        fold[whole] = data[whole]
        new = np.zeros(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= kind == _DIGIT
        new &= (kind != _SPACE) & ~whole
        new[w.starts] = True
        starts = np.flatnonzero(new)
        # A span ends where the next begins or where its chunk ends.
        chunk_end = np.repeat(w.ends, np.add.reduceat(new.astype(np.int64), w.starts) if len(w.starts) else size)
        ends = np.minimum(np.append(starts[1:], n), chunk_end)
        return fold, starts, ends, kind[starts] == _LETTER if not odd.any() else (kind[starts] == _LETTER) & ~whole[starts]

    def _step(self, w: H.Words, end_id: int) -> pa.Array:
        fold, starts, ends, plain = self._spans(w)
        keys = H.spans(fold, starts, ends) | H.U64(1)
        table = self.table
        entry = table.find(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            if table.n + len(fresh) > MOST:
                table.clear()
                if len(fresh) <= MOST // 2:
                    return self._step(w, end_id)
            raw = fold.tobytes()
            for pick, tok in ((plain[at], self.bare), (~plain[at], self.tok)):
                if pick.any():
                    some = at[pick]
                    ids, size = self._ids(tok, [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
                    table.add(fresh[pick], ids, size)
            entry[new] = table.find(keys[new])
        size = table.size[entry].astype(np.int64)
        texts = len(w.offsets) - 1
        first = np.searchsorted(starts, w.offsets)
        upto = np.append(0, np.cumsum(size))
        per_text = upto[first[1:]] - upto[first[:-1]] + 1
        begin = np.append(0, np.cumsum(per_text))
        out = np.full(begin[-1], end_id, self.dtype)
        place = np.ones(begin[-1], bool)
        place[begin[1:] - 1] = False
        total = int(upto[-1])
        out[place] = table.flat[np.repeat(table.at[entry] - upto[:-1], size) + np.arange(total)]
        width = self.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer((begin * width).astype(np.int32)), pa.py_buffer(out)])


_loaded: dict[tuple, Encoder] = {}


def encoder(path: str, by_chunk: bool) -> Encoder:
    if (path, by_chunk) not in _loaded:
        _loaded[path, by_chunk] = Encoder(path, by_chunk)
    return _loaded[path, by_chunk]
