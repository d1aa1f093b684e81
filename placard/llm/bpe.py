"""Byte-level BPE: exact merges by backtracking over longest matches, and cached encoding of whole texts."""

from __future__ import annotations

import base64
import json
import re

import ahocorasick
import regex

#: Pieces that an encoder keeps; a fuller cache starts anew, so its memory is bounded.
CACHE_PIECES = 200_000

# The classes \p{L}, \p{N} and \s of the split pattern, restricted to Latin-1.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANKS = "\t-\r \u0085 "
_LATIN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)


def splitter(pattern: str):
    """A function that gives every match of ``pattern`` in a text.

    Texts within Latin-1 take the standard library's matcher with the same classes spelled out, if ``pattern`` is
    the usual one of byte-level vocabularies; all others take ``regex``.
    """
    usual = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    general = regex.compile(pattern)
    if pattern != usual:
        return general.findall

    def pieces(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general.findall(text)
        return _LATIN.findall(text)

    return pieces


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a ``.tiktoken`` rank file or the vocabulary of a byte-level ``.json`` file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        visible = {c: b for b, c in _visible_bytes().items()}
        return {bytes(visible[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _visible_bytes() -> dict[int, str]:
    """Byte-level files write each byte as one visible character: itself if printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Backtracker:
    """Encodes one piece exactly as merging by lowest rank would.

    An encoding is right exactly if every two neighbouring tokens are compatible: merging their joint bytes gives
    the two tokens again. The automaton gives the longest token at every byte; the encoder takes it, shortens it
    while it clashes with the token before, and steps back where no length fits, never trying a byte twice.
    Compatibility of two tokens is memoised.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            left = self.shorter[rank]
            while left is not None:
                right = ranks.get(token[self.length[left] :])
                if right is not None and left < rank and right < rank and self._compatible(left, right):
                    self.made[left, right], self.halves[rank] = rank, (left, right)
                    break
                left = self.shorter[left]

    def _compatible(self, left: int, right: int) -> bool:
        """Undoes the later of the two tokens' last merges, again and again; a merge across the seam that would
        have come before the one just undone shows that the tokens could not have formed."""
        before = 1 << 62
        while True:
            across = self.made.get((left, right))
            if across is not None and across < before:
                return False
            if left > right and left in self.halves or right not in self.halves:
                if left not in self.halves:
                    return True
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2 * CACHE_PIECES:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length = len(piece), self.length
        longest: list[int | None] = [None] * (n + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token is not None:
                end = at + length[token]
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += length[token]
                token = longest[at]
            elif out:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError("the vocabulary lacks single bytes of this text")
        return out


class Cached(dict):
    """Piece to encoded value; a piece that is missing is encoded, and a full cache starts anew."""

    def __init__(self, encode, limit: int = CACHE_PIECES):
        super().__init__()
        self._encode, self._limit = encode, limit

    def __missing__(self, piece):
        if len(self) >= self._limit:
            self.clear()
        value = self[piece] = self._encode(piece)
        return value
