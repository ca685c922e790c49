"""Token ids of whole texts with a public tokenizer, encoding each distinct segment of text once.

A text is cut only where the tokenizer cuts anyway, so the ids of the segments in a row are the ids
of the text; a bounded cache keeps the segments that the library has encoded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
from tokenizers import Tokenizer

#: Segments kept at most, about 200 bytes each; then the cache starts anew.
MOST_SEGMENTS = 1_500_000
#: Segments that one call of the library encodes, joined by a separator of its own id.
JOINED = 256

#: Bytes by kind: a letter or digit (with those of two-byte letters), white space, full stop or comma, other.
_KINDS = bytes(
    ord("a") if chr(b).isalnum() and b < 128 or b > 127 else ord(" ") if b in b" \t\n\x0b\x0c\r" else ord(".") if b in b".," else ord("#")
    for b in range(256))
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \n])")


def _kinds(text: bytes) -> bytes | None:
    """The kind of each byte of a text of ASCII and the letters U+00C0 to U+00FF; None for any other text."""
    if not text.isascii():
        if np.frombuffer(text, np.uint8).max() > 0xC3 or b"\xc2" in text or b"\xc3\x97" in text or b"\xc3\xb7" in text:
            return None
    return text.translate(_KINDS)


def tokenizer_space(tokenizer: Tokenizer) -> str:
    ((space, _),) = tokenizer.pre_tokenizer.pre_tokenize_str(" ")
    return space


class SegmentEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``keeps_space`` tells the two kinds of tokenizers apart: byte-level ones, which put white space
    into tokens (one space before a word, a run otherwise), and those that drop it. A text that
    holds the string of a special token is encoded whole, so the token gets its id as the library
    gives it by default. An empty text has no ids; nulls are the caller's to replace.
    """

    def __init__(self, path: str, keeps_space: bool) -> None:
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        # Segments never hold such a string; joined ones must not make one up.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.separator, self.mark = ("\n", "\n") if keeps_space else (" | ", "|")
        (self.separator_id,) = self._ids(self.mark)
        # How the model writes a space; it takes words without white space and signs directly.
        self.space = tokenizer_space(self.tokenizer) if keeps_space else None
        self.cache: dict[bytes | str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def segments(self, text: bytes) -> list:
        """Parts that are encoded alone as they are within the text.

        In plain texts full stops and commas are parts of their own (where white space is dropped) or
        begin one, unless they touch other signs or, where it is kept, white space.
        """
        kinds = _kinds(text)
        if not self.keeps_space:
            if kinds is None or b".." in kinds or b"#." in kinds or b".#" in kinds:
                return text.split()
            return text.lower().replace(b".", b" . ").replace(b",", b" , ").split()
        if kinds is None or b"\0" in text or kinds[:1] == b"." or b"  " in kinds or b" ." in kinds or b".." in kinds or b"#." in kinds:
            return _BEFORE_SPACE.split(text.decode())
        text = text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")
        return text.replace(b".", b"\0.").replace(b",", b"\0,").split(b"\0")

    def _joinable(self, segment: str) -> bool:
        if self.mark in segment:
            return False
        inner = segment[1:] if segment[:1] == " " else segment
        return bool(inner) and not inner[0].isspace() and not inner[-1].isspace()

    def _word(self, segment: bytes) -> str | None:
        """What the model itself takes for a segment of ASCII letters; None for other segments."""
        if self.keeps_space and segment[:1] == b" ":
            return self.space + segment[1:].decode() if segment[1:].isalpha() else None
        return segment.decode() if segment.isalpha() and (self.keeps_space or segment.islower()) else None

    def _learn(self, segments: Iterable) -> None:
        joined, texts = [], []
        tokenize = self.tokenizer.model.tokenize
        for segment in segments:
            if isinstance(segment, bytes) and (word := self._word(segment)) is not None:
                self.cache[segment] = array("I", [t.id for t in tokenize(word)]).tobytes()
                continue
            text = segment if isinstance(segment, str) else segment.decode()
            if self._joinable(text):
                joined.append(segment)
                texts.append(text)
            else:
                self.cache[segment] = np.array(self._ids(text), "<u4").tobytes()
        for start in range(0, len(joined), JOINED):
            found = self.tokenizer.encode_batch_fast(
                [self.separator.join(texts[start : start + JOINED])], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.separator_id), len(ids)).tolist()
            part, data, at = joined[start : start + JOINED], ids.tobytes(), 0
            if len(ends) != len(part):
                raise ValueError("the separator isn't a token of its own")
            for segment, end in zip(part, ends, strict=True):
                self.cache[segment] = data[4 * at : 4 * end]
                at = end + 1

    def _special(self, text: bytes) -> bool:
        """Whether a special token's string may be in the text; case doesn't count, since tokenizers may lower it first."""
        return any(s in text or s in text.lower() for s in self.specials)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8), as little-endian unsigned 32-bit integers."""
        cut = [None if self._special(text) else self.segments(text) for text in texts]
        held: set = set()
        for segments in cut:
            held.update(segments or ())
        missing = [s for s in held if s not in self.cache]
        if len(self.cache) + len(missing) > MOST_SEGMENTS:
            self.cache.clear()
            missing = list(held)
        self._learn(missing)
        return [
            b"".join(map(self.cache.__getitem__, segments)) if segments is not None
            else np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            for text, segments in zip(texts, cut, strict=True)]


_encoders: dict[tuple[str, bool], SegmentEncoder] = {}


def encoder(path: str, keeps_space: bool) -> SegmentEncoder:
    """The encoder of this Python worker, with what its cache has from earlier tasks."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = SegmentEncoder(path, keeps_space)
    return _encoders[path, keeps_space]
