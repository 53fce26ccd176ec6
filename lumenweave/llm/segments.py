"""Texts as sequences of repeated segments, and byte-level BPE of distinct segments.

A segment starts at every space that follows a character other than white space. The
splitting pattern of byte-level BPE matches white space only at the beginning of a match
(or as a match of its own) and looks at no character before it, so no token crosses such
a place and segments encode as they do inside their text. ``ByteBpe.splits`` verifies on the
vocabulary that no entry has a space after another character.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: White space of one byte; the four separators 0x1C to 0x1F count too, which only means fewer segments.
_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
#: Segments given to the library in one string.
JOINED = 512
#: Entries that a worker remembers in each of two generations.
MEMO = 1 << 18
#: Single segments of more characters than this are cut at places where no token can cross.
LONG_SEGMENT = 1 << 16


def _after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each of ``at`` is white space (Unicode White_Space)."""
    b1 = data[at - 1]
    b2 = np.where(at > 1, data[at - 2], 0)
    b3 = np.where(at > 2, data[at - 3], 0)
    wide = (b3 == 0xE2) & (((b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))) | ((b2 == 0x81) & (b1 == 0x9F)))
    wide |= ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)) | ((b3 == 0xE1) & (((b2 == 0x9A) & (b1 == 0x80)) | ((b2 == 0xA0) & (b1 == 0x8E))))
    return _WHITE[b1] | ((b1 >= 0x80) & (wide | ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)))))


def _letters() -> np.ndarray:
    """Whether each code point below 0x530 is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x530)])


_LETTER = _letters()
_ASCII_LETTER = np.concatenate([_LETTER[:0x80], np.zeros(0x80, bool)])
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != ord("'")]] = True


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each of ``at`` is a letter of one or two bytes."""
    b1, b2 = data[at - 1], np.where(at > 1, data[at - 2], 0)
    code = ((b2.astype(np.int32) & 31) << 6) | (b1 & 63)
    return _ASCII_LETTER[b1] | ((b2 >= 0xC2) & (b2 <= 0xD4) & (b1 >= 0x80) & _LETTER[np.minimum(code, len(_LETTER) - 1)] & (code < len(_LETTER)))


def _places(data: np.ndarray, fine: bool) -> np.ndarray:
    """Where segments start, beginnings of texts apart."""
    at = np.flatnonzero((_WHITE if fine else np.arange(256) == 0x20)[data])
    at = at[at > 0]
    at = at[~_after_white(data, at)]
    if not fine:
        return at
    marks = np.flatnonzero(_PUNCTUATION[data])
    marks = marks[marks > 0]
    # behind one line feed between two other characters
    lines = at[(data[at] == 0x0A) & (at + 1 < len(data))] + 1
    lines = lines[(data[lines] < 0x80) & ~_WHITE[data[lines]]]
    return np.sort(np.concatenate([at, marks[_after_letter(data, marks)], lines]), kind="stable")


def split(texts: pa.Array, whole: bool = False, fine: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Segment number of every segment in turn, the segments before each text's end, and the distinct segments.

    ``texts``: large_binary without nulls. An empty text has no segments. ``whole``: one segment for each text.
    ``fine``: more places where byte-level BPE alone can't merge across: in front of any white-space run, between a
    letter and a punctuation mark other than an apostrophe, and behind a single line feed.
    """
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None else np.zeros(0, np.uint8)
    starts = offsets[:-1][np.diff(offsets) > 0]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(n, np.int64), []
    if not whole:
        starts = np.sort(np.concatenate([starts, _places(data, fine) + low]), kind="stable")
        starts = starts[np.diff(starts, prepend=-1) > 0]
    edges = np.append(starts, high).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), raw]).dictionary_encode()
    return coded.indices.to_numpy(), np.searchsorted(starts, offsets[1:]), coded.dictionary.to_pylist()


def as_bytes(texts: pa.Array, lead: str = "") -> pa.Array:
    """``lead`` + text as large_binary; null and empty texts are empty, without ``lead``."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not lead:
        return texts
    full = pa.compute.binary_join_element_wise(pa.scalar(lead.encode(), pa.large_binary()), texts, pa.scalar(b"", pa.large_binary()))
    return pa.compute.if_else(pa.compute.equal(pa.compute.binary_length(texts), 0), pa.scalar(b"", pa.large_binary()), full)


def _joins(segment: str) -> bool:
    """Whether a segment may follow another in one string: white space only inside it, and one space in front."""
    body = segment[1:] if segment[0] == " " else segment
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


def _crosses(token: bytes) -> bool:
    """Whether a token holds a space right after a character other than white space."""
    data = np.frombuffer(token, np.uint8)
    at = np.flatnonzero(data[1:] == 0x20) + 1
    return bool(len(at)) and not _after_white(data, at).all()


def byte_level() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies, by their public rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level tokenizer of the tokenizers library (its JSON file) over segments."""

    def __init__(self, spec: str, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._coder = Tokenizer.from_str(spec)
        self._coder.encode_special_tokens = not special
        table, kind = byte_level(), json.loads(spec)
        added = {t["id"]: t["content"].encode() for t in kind["added_tokens"]}
        vocabulary = self._coder.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = added[i] if i in added else bytes(table[c] for c in piece)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        pre = kind["pre_tokenizer"] or {}
        plain = kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.added = list(added.values())
        self.splits = bool(plain) and not any(map(_crosses, self.bytes))
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def holds_added(self, texts: pa.Array) -> bool:
        """Whether a text holds an added token, which ``fine`` segments might cut."""
        return any(pa.compute.any(pa.compute.match_substring(texts.cast(pa.large_string(), safe=False), t.decode())).as_py() for t in self.added)

    def _alone(self, segment: bytes) -> bytes:
        from lumenweave.llm.bpe import safe_chunks

        text = segment.decode(errors="replace")
        parts = safe_chunks(text, LONG_SEGMENT) if self.splits else [text]
        return b"".join(np.array(self._coder.encode(p, add_special_tokens=False).ids, "<i4").tobytes() for p in parts)

    def _together(self, segments: list[bytes]) -> list[bytes]:
        """Segments that can follow each other, encoded as one string and cut by bytes."""
        # a line feed in front of a segment that starts with another character is a token of its own
        bare = np.array([s[0] != 0x20 for s in segments])
        text = b"".join([b"\n" + s if lone else s for s, lone in zip(segments, bare.tolist())])
        ids = np.array(self._coder.encode_batch_fast([text.decode(errors="replace")], add_special_tokens=False)[0].ids, "<i4")
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        size = np.array([len(s) for s in segments])
        stop = np.cumsum(size + bare)
        first, last = np.searchsorted(ends, stop - size), np.searchsorted(ends, stop)
        if last[-1] >= len(ends) or (ends[first] != stop - size).any() or (ends[last] != stop).any():
            return [self._alone(s) for s in segments]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist())]

    def encode(self, segments: list[bytes], memo: bool = True) -> list[bytes]:
        """The ids of each segment as little-endian 32-bit integers. Without ``memo`` none are remembered, as where no segment comes twice."""
        new, old = self._new, self._old
        out = list(map(new.get, segments))
        missing = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = out[i] = old.get(segments[i])
            if ids is None:
                missing.append(i)
            else:
                new[segments[i]] = ids
        joint = []
        for i in missing:
            s = segments[i]
            # printable ASCII at both ends needs no closer look
            plain = 0x20 < s[-1] < 0x7F and (0x20 < s[0] < 0x7F or (s[0] == 0x20 and len(s) > 1 and 0x20 < s[1] < 0x7F))
            if self.splits and len(s) <= 256 and (plain or _joins(s.decode(errors="replace"))):
                joint.append(i)
            else:
                out[i] = self._alone(s)
        for k in range(0, len(joint), JOINED):
            some = joint[k : k + JOINED]
            for i, ids in zip(some, self._together([segments[i] for i in some])):
                out[i] = ids
        for i in missing if memo else ():
            if len(segments[i]) <= 256:
                new[segments[i]] = out[i]
        if len(new) > MEMO:
            self._old, self._new = new, {}
        return out


@lru_cache(maxsize=2)
def byte_bpe(spec: str, special: bool = True) -> ByteBpe:
    """One tokenizer for each worker process and vocabulary."""
    return ByteBpe(spec, special)
