"""Token ids of whole texts with a public tokenizer file (the ``tokenizers`` library).

The library encodes about 1 MB/s and core.  Byte-level BPE splits a text at white space before it
merges, so equal pieces between spaces have equal ids; they are encoded once per Python worker and
looked up after that.  Texts for which the split could differ (other white space, the special
token's string, other kinds of tokenizer) are handed to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from synthkit.llm.common import worker_table

END_ID = 2
LONGEST = 200  # characters of a part or piece that is kept; with the number of entries it bounds the tables' bytes
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
#: A run of letters up to an ASCII non-letter or the end; else up to a space; else white space.
_PART = re.compile(rf" ?[{_LETTERS}]+(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|\Z)| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]|<\|")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _plain_parts(key: str) -> list[str] | None:
    """Parts of a piece of letters with at most one mark behind it, as the pattern gives them; None: another piece."""
    head, body = (["\n"], key[1:]) if key[0] == "\n" else ([], key)
    tail = [body[-1]] if body[-1] in ".,;:!?" else []
    word = body[:-1] if tail else body
    if word.isalpha() and (word.isascii() or max(word) <= "ʯ"):
        return [*head, word if head else " " + word, *tail]
    return None


def _is_word(part: str) -> bool:
    """One run of letters, with or without a space before it."""
    word = part[1:] if part[0] == " " else part
    return word.isalpha() and (word.isascii() or max(word) <= "ʯ")


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes, without an end id.

    ``max_entries`` bounds the table of known word parts, half of it that of pieces.  A full table
    becomes the old one, from which entries still in use are taken over (results stay the same).
    """

    def __init__(self, path: str | None = None, max_entries: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path or default_path())
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                         and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
                         and all(t["content"].startswith("<|") for t in spec["added_tokens"]))
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        # the character that stands for each byte, as the pre-tokenizer shows it
        self._shown = {0x20: shown.pre_tokenize_str(" ")[0][0]}
        for point in range(0x80, 0x800):
            for byte, char in zip(chr(point).encode(), shown.pre_tokenize_str(chr(point))[0][0]):
                self._shown[byte] = char
        self._pieces: dict[str, bytes | None] = {}
        self._parts: dict[str, bytes] = {}
        self._old_pieces: dict[str, bytes | None] = {}
        self._old_parts: dict[str, bytes] = {}
        self.max_entries = max_entries

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        got = self._parts.get(part)
        if got is None:
            got = self._old_parts.get(part)
            if got is None:
                if len(part) < 200 and _is_word(part):
                    shown = (part.replace(" ", self._shown[0x20]) if part.isascii()
                             else part.encode().decode("latin-1").translate(self._shown))
                    got = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
                else:
                    got = self.whole(part)
            if len(part) <= LONGEST:
                if len(self._parts) >= self.max_entries:
                    self._old_parts, self._parts = self._parts, {}
                self._parts[part] = got
        return got

    def _piece(self, key: str) -> bytes | None:
        """Ids of a piece between spaces (with the space or line break before it); None: look at the whole text."""
        if key in self._old_pieces:
            got = self._old_pieces[key]
        elif key in ("", "\n"):
            got = None
        elif (parts := _plain_parts(key)) is not None:
            got = b"".join(map(self._part, parts))
        elif _ODD.search(key):
            got = None
        else:
            got = b"".join(map(self._part, _PART.findall(key if key[0] == "\n" else " " + key)))
        if len(key) <= LONGEST:
            if len(self._pieces) >= self.max_entries // 2:
                self._old_pieces, self._pieces = self._pieces, {}
            self._pieces[key] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return self.whole(text)
        keys = text.replace("\n", " \n").split(" ")
        first = keys[0]
        if first and not _ODD.search(first):
            keys[0] = "\n"
            known = self._pieces
            out = [known.get(k) or self._piece(k) for k in keys]
            out[0] = b"".join(map(self._part, _PART.findall(first)))
            if None not in out:
                return b"".join(out)
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self._part, _PART.findall(text)))


def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker, kept between tasks of the same step."""
    return worker_table(("encoder", path), lambda: Encoder(path))
