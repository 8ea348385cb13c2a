"""Ids of whole texts by the tokenizers library, with the ids of frequent pieces kept.

Both vocabularies cut a text into pieces that are encoded alone. A piece that was seen before is looked up; the others go
through the library. The store of pieces is bounded; what doesn't fit is encoded each time.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

KEPT = 1_000_000
#: Bytes of the longest piece that is kept.
LONGEST = 48
#: Texts of these are single words between single blanks or newlines, where the byte-level pattern always cuts.
PLAIN = "!-~¡-ɏ"
PLAIN_TEXT = re.compile(f"[{PLAIN}]++(?:[ \n][{PLAIN}]++)*+")
PLAIN_PIECE = re.compile(rb"\n| ?[^ \n]+")
#: A word of Latin letters, each one code point in both normal forms and cases, and a full stop or comma that both patterns hold apart from it.
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])"
WORD = re.compile(rb"( ?" + _LETTER + rb"++)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as themselves, the others by letters from U+0100 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
_encoders: dict[tuple[str, int], Encoder] = {}


class Places(dict):
    """Places of pieces in a list, given as they come; new pieces are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_space = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.places, self.ids = Places(), []
        self.mark = b"\x01" if self.by_space else b"\n"
        self.joint = b" \x01 " if self.by_space else b"\n"
        self.after = {m: array("I", self.tokenizer.encode(m.decode(), add_special_tokens=False).ids).tobytes() for m in (b"", b".", b",")}
        (self.mark_id,) = self.tokenizer.encode(self.mark.decode(), add_special_tokens=False).ids

    def pieces(self, text: bytes) -> list[bytes]:
        s = text.decode()
        if any(t in s for t in self.special):
            return [text]  # the library finds special tokens in the whole
        if self.by_space:
            return text.split()
        return PLAIN_PIECE.findall(text) if PLAIN_TEXT.fullmatch(s) else [text]

    def encode_pieces(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new pieces. Words of Latin letters go straight to the model, which is all that the library does to them. Other short pieces
        are joined by a mark that both vocabularies hold apart, and the ids cut at its id."""
        out, others, tokenize = {}, [], self.tokenizer.model.tokenize
        for p in new:
            m = WORD.fullmatch(p)
            if m is None:
                others.append(p)
                continue
            w = m[1].decode().lower().encode() if self.by_space else m[1]
            w = w.decode().replace(" ", BYTE_LETTERS[32]) if w.isascii() else w.decode("latin-1").translate(BYTE_LETTERS)
            out[p] = array("I", [t.id for t in tokenize(w)]).tobytes() + self.after[m[2]]
        new = others
        short = [p for p in new if len(p) <= LONGEST and self.mark not in p]
        out |= {p: array("I", self.tokenizer.encode(p.decode(), add_special_tokens=False).ids).tobytes() for p in new if len(p) > LONGEST or self.mark in p}
        if short:
            text = self.joint.join(short) + self.joint
            ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id) * 4
            if len(ends) != len(short):
                raise ValueError("pieces and ids don't match")
            raw, at = ids.tobytes(), 0
            for p, end in zip(short, ends.tolist(), strict=True):
                out[p] = raw[at:end]
                at = end + 4
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. Short pieces that came among the first `kept` stay known."""
        places, ids, before = self.places, self.ids, len(self.places)
        at = [list(map(places.__getitem__, self.pieces(t))) if t else [] for t in texts]
        if new := places.new:
            fresh = self.encode_pieces(new)
            ids += map(fresh.__getitem__, new)
            places.new = []
        out = [b"".join(map(ids.__getitem__, x)) for x in at]
        if len(ids) > self.kept or any(len(p) > LONGEST for p in new):
            for p in new:
                del places[p]
            del ids[before:]
            for p in new:
                if len(p) <= LONGEST and len(ids) < self.kept:
                    places[p] = len(ids)
                    ids.append(fresh[p])
        return out


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """The worker's encoder of this file: loaded once, with its pieces, for all tasks of the worker."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def encode_sliced(enc: Encoder, texts: list[bytes], step: int = 1 << 20):
    """encode() over slices of about `step` bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= step:
            yield from enc.encode(part)
            part, size = [], 0
    if part:
        yield from enc.encode(part)
