"""Token ids of whole texts for a byte-level BPE vocabulary, remembered piece by piece.

A space that is followed by a character other than white space always begins a token, so a text may be
cut there and the ids of the cuts follow each other.  Texts repeat most of their cuts; each is encoded once.
"""

from __future__ import annotations

import base64
import json
import re

from labelweave.llm.common import Remembered

#: Bytes of cuts and ids that a task remembers.
CACHE_BYTES = 32 << 20

#: a space before more white space or the end: such texts are not cut
_LOOSE = re.compile(r" (?:\s|$)")


def cut(text: str) -> list[str] | None:
    """The text in cuts that are tokenized independently; None if it has to stay whole."""
    if _LOOSE.search(text):
        return None
    parts = text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PieceIds(Remembered):
    """Cut -> its ids as little-endian unsigned 32-bit integers; forgets everything when it is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(CACHE_BYTES)
        import tiktoken

        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        from array import array

        ids = array("I", self._encode(text))
        return ids.tobytes()

    def __missing__(self, piece: str) -> bytes:
        value = self.whole(piece)
        return self.keep(piece, value, len(piece) + len(value))

    def encode(self, text: str) -> bytes:
        pieces = cut(text)
        return self.whole(text) if pieces is None else b"".join(map(self.__getitem__, pieces))


def load_added(path: str) -> dict[str, int]:
    """Added tokens of a tokenizers JSON file, which stand for their exact text wherever it occurs."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match their exact text are known")
    return {t["content"]: t["id"] for t in added}


class MarkedIds:
    """Ids of texts in which added tokens stand for themselves; the texts between them are encoded by ``pieces``."""

    def __init__(self, pieces: PieceIds, added: dict[str, int]):
        self._pieces, self._added = pieces, {t: i.to_bytes(4, "little") for t, i in added.items()}
        # the longest one first where several begin
        self._marks = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) if added else r"(?!)")

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        for mark in self._marks.finditer(text):
            if mark.start() > at:
                out.append(self._pieces.encode(text[at : mark.start()]))
            out.append(self._added[mark.group()])
            at = mark.end()
        return b"".join([*out, self._pieces.encode(text[at:])]) if at else self._pieces.encode(text)
