"""Token ids of whole texts, from a public tokenizer file and the ``tokenizers`` library.

A byte-pair tokenizer never merges across the cut in front of a run of white
space, so a text may be encoded piece by piece, and a piece that comes again
need not be encoded again.  :class:`PieceEncoder` cuts a batch of texts with a
few array passes over its bytes, lets the library encode the distinct pieces it
hasn't met lately, and puts the ids together.  Where that would not be exact (a
tokenizer file of another kind, white space beyond ASCII in a text) the library
gets the whole text.  Both ways give the same ids (tests/llm/test_encoding.py).

Rules: a null text counts as empty; strings of special tokens inside a text are
ordinary text; nothing is added.
"""

from __future__ import annotations

import ctypes
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
#: First bytes of the characters that some engine counts as white space, beside the six above.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: The bytes behind them; None stands for a single byte.
_ODD_REST = {
    0xC2: {(0x85,), (0xA0,)},
    0xE1: {(0x9A, 0x80), (0xA0, 0x8E)},
    0xE2: {*((0x80, x) for x in (*range(0x80, 0x90), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F), (0x81, 0xA0)},
    0xE3: {(0x80, 0x80)},
    0xEF: {(0xBB, 0xBF)},
}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of a text worked on at once.
_LONG = 4_000_000
#: Pieces longer than this aren't remembered.
_KEEP_BYTES = 64
#: About the bytes that a piece remembered takes besides its own and its ids'.
_ENTRY = 160


class PieceEncoder:
    """Encode texts with a tokenizer file; ``keep`` bounds the bytes of the pieces remembered (two generations of so many)."""

    def __init__(self, path: str, keep: int = 40 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._keep, self._held = keep, 0
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self._bare = None
        if self.kind:
            size = np.zeros(self._tokenizer.get_vocab_size(), np.int64)
            for token, i in self._tokenizer.get_vocab().items():  # a character stands for a byte
                size[i] = len(token.removesuffix("</w>") if self.kind == "dropped" else token)
            self._size = size
            self._bare = Tokenizer.from_file(path)
            self._bare.encode_special_tokens = True
            if self.kind == "dropped":
                self._bare.normalizer = Sequence([])

    def plain(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, little-endian unsigned 32-bit."""
        return [np.asarray(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (one more than there are texts)."""
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
        texts = texts.fill_null("")
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        whole = np.ones(n, bool) if self.kind is None else _odd(raw, ends)
        if whole.all():
            return _joined(self.plain(texts.to_pylist()))
        long = ~whole & (np.diff(ends) > _LONG)
        if split and long.any():  # in parts, so that memory doesn't grow with the length of a text
            ids = []
            for i in range(n):
                parts = _parts(raw[ends[i] : ends[i + 1]]) if long[i] else [texts[i : i + 1]]
                ids.append(np.concatenate([self.encode(p, split=False)[0] for p in parts]))
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        if not whole.any():
            return self._pieces(raw, ends)
        ids, starts = self._pieces(*_without(raw, ends, whole))
        parts = np.split(ids, starts[1:-1])
        for i, got in zip(np.flatnonzero(whole), self.plain(texts.filter(pa.array(whole)).to_pylist())):
            parts[i] = np.frombuffer(got, "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _pieces(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        space = _SPACE[raw]
        first = np.zeros(n, bool)
        first[ends[:-1][ends[:-1] < n]] = True
        after = np.concatenate([[False], _ALNUM[raw[:-1]]])
        if self.kind == "spaced":
            cut = first | (space & ~np.concatenate([[False], space[:-1]])) | (_STOP[raw] & after)
            at = np.flatnonzero(cut)
        else:  # white space is dropped, ASCII letters lower-cased unless a combining mark may follow
            cut = ~space & (first | np.concatenate([[False], space[:-1]]) | (_STOP[raw] & after))
            raw = np.where(np.concatenate([raw[1:] < 0x80, [True]]), _LOWER[raw], raw)[~space]
            moved = np.concatenate([[0], np.cumsum(~space, dtype=np.int32)])
            ends, at = moved[ends], moved[np.flatnonzero(cut)]
        if not len(at):
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        offsets = np.concatenate([at, [len(raw)]]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        which, got = pieces.indices.to_numpy(), self._look_up(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        start = np.cumsum(size) - size
        n_ids = size[which]
        before = np.cumsum(n_ids) - n_ids
        total = int(n_ids.sum())
        ids = flat[np.repeat(start[which] - before, n_ids) + np.arange(total)]
        edge = np.searchsorted(at, ends)  # the pieces in front of each text
        return ids, np.concatenate([before, [total]])[edge]

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        young, old = self._young, self._old
        got = list(map(young.get, pieces))
        new = [i for i, x in enumerate(got) if x is None]
        if not new:
            return got
        fresh = []
        for i in new:
            if (x := old.get(pieces[i])) is None:
                fresh.append(i)
            else:
                got[i] = young[pieces[i]] = x
                self._held += len(x) + len(pieces[i]) + _ENTRY
        for i in range(0, len(fresh), 2048):
            part = fresh[i : i + 2048]
            for k, ids in zip(part, self._encode_pieces([pieces[k] for k in part])):
                got[k] = ids
                if len(pieces[k]) <= _KEEP_BYTES:
                    young[pieces[k]] = ids
                    self._held += len(ids) + len(pieces[k]) + _ENTRY
        if self._held > self._keep:
            self._old, self._young, self._held = young, {}, 0
        return got

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """As ``plain``, with the pieces that allow it joined into one text; the sizes of the tokens must meet every seam."""
        gap = b"" if self.kind == "spaced" else b" "
        join = [i for i, p in enumerate(pieces) if (p[:1] == b" " and p[1:2] > b" " if self.kind == "spaced" else p.lower() == p if p.isascii() else _settled(p.decode()))]
        text = gap.join([pieces[i] for i in join])
        ids = np.asarray(self._bare.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")
        seams = np.cumsum([len(pieces[i]) for i in join])
        reached = np.cumsum(self._size[ids])
        cut = np.searchsorted(reached, seams) + 1
        if len(join) == 0 or cut[-1] != len(ids) or (reached[cut - 1] != seams).any():
            return self.plain([p.decode() for p in pieces])
        out: list = [None] * len(pieces)
        raw, end = ids.tobytes(), 0
        for i, stop in zip(join, (4 * cut).tolist()):
            out[i], end = raw[end:stop], stop
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.plain([pieces[i].decode() for i in rest]) if rest else []):
            out[i] = x
        return out


def _settled(piece: str) -> bool:
    """Whether NFC and lower-casing leave a piece as it is."""
    return piece.islower() and piece.lower() == piece and unicodedata.is_normalized("NFC", piece)


def _parts(raw: np.ndarray) -> Iterator[pa.Array]:
    """A text in parts, cut in front of runs of white space."""
    at = 0
    while len(raw) - at > _LONG:
        ahead = raw[at + _LONG - 1 :]
        for step in range(0, len(ahead), 1 << 16):  # the next seam
            space = _SPACE[ahead[step : step + (1 << 16) + 1]]
            seams = np.flatnonzero(space[1:] & ~space[:-1])
            if len(seams):
                stop = at + _LONG + step + int(seams[0])
                break
        else:
            break
        yield pa.array([raw[at:stop].tobytes()], pa.large_binary()).cast(pa.large_string())
        at = stop
    yield pa.array([raw[at:].tobytes()], pa.large_binary()).cast(pa.large_string())


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u4"), np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)


def _odd(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts hold white space beyond ASCII."""
    out = np.zeros(len(ends) - 1, bool)
    at = np.flatnonzero(_ODD[raw])
    if len(at):
        pad = np.concatenate([raw, [0, 0]])
        lead, second, third = raw[at], pad[at + 1], pad[at + 2]
        bad = lead < 0x20
        for first, rests in _ODD_REST.items():
            for rest in rests:
                bad |= (lead == first) & (second == rest[0]) & (len(rest) == 1 or third == rest[-1])
        out[np.searchsorted(ends, at[bad], side="right") - 1] = True
    return out


def _without(raw: np.ndarray, ends: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with some texts emptied."""
    size = np.diff(ends)
    return raw[np.repeat(~drop, size)], np.concatenate([[0], np.cumsum(np.where(drop, 0, size))])


def _kind(spec: dict) -> str | None:
    """How a tokenizer treats white space, or None if its ids may depend on what stands before a run of it."""
    if spec.get("model", {}).get("type") != "BPE" or spec["model"].get("dropout") or spec.get("truncation"):
        return None
    listed = lambda x, key: [] if x is None else x[key] if key in x else [x]
    normal, before = listed(spec.get("normalizer"), "normalizers"), listed(spec.get("pre_tokenizer"), "pretokenizers")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        return None
    kinds = [p["type"] for p in before]
    if kinds == ["ByteLevel"] and not normal and before[0].get("use_regex", True) and not before[0].get("add_prefix_space"):
        return "spaced"
    if [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1].get("pattern") == {"Regex": r"\s+"} and normal[1].get("content") == " ":
        split = kinds == ["Split", "ByteLevel"] and before[0].get("behavior") == "Removed" and before[0].get("invert")
        return "dropped" if split and not before[1].get("add_prefix_space") and r"[^\s\p{L}\p{N}]" in before[0].get("pattern", {}).get("Regex", "") else None
    return None


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def slices(texts: pa.Array, size: int = 3_400_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes at most, one row at least."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 64
    at, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + size, side="right")))
        yield start, stop
        start = stop
    _release()


def _release() -> None:
    """Give freed memory back to the system; a worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass
