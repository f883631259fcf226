"""Token ids of whole texts by the ``tokenizers`` library, with a cache of pre-tokens or units.

A byte-level tokenizer cuts a text into pre-tokens and merges each on its own. For texts of Latin
letters and common signs the cuts are made here, by the tokenizer's own pattern over those characters,
and only pre-tokens that the worker has not seen go through the library's BPE model. Other texts are
cut at ASCII white space, which no pre-token crosses, and new units are encoded by the library. Texts
for which that does not hold either (other white space, text that looks like a special token) are
encoded whole, and so is everything for a tokenizer file of another kind. The ids are always the
library's; ``tests/llm`` compares them.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import megabytes_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens and units that a worker keeps, and the longest that it keeps.
CACHE_UNITS = 800_000
LONGEST_CACHED = 64

_WS = " \t\n\r\x0b\x0c"
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters and numbers, by Unicode category, up to U+017F; the signs that may stand beside them.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u0148\u014a-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
_SHORT = "'(?:s|t|re|ve|m|ll|d)"


class _Kind:
    """How a kind of tokenizer cuts: the pre-tokens of plain texts, the units of others, whether it lowers case first."""

    def __init__(self, plain: str, unit: str, lower: bool):
        self.plain, self.unit, self.lower = re.compile(plain), re.compile(unit), lower


#: Spaces belong to the word after them.
_SPACE_JOINED = _Kind(
    rf"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_WS}{_LETTER}{_NUMBER}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+",
    rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]",
    False,
)
#: White space is dropped and letters are in lower case.
_SPACE_DROPPED = _Kind(rf"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^{_WS}{_LETTER}{_NUMBER}]+", rf"[^{_WS}]+", True)


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if a.itemsize != 4 or os.sys.byteorder != "little":
        return b"".join(int(i).to_bytes(4, "little") for i in ids)
    return a.tobytes()


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 ones as they are, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class _PreTokens(dict):
    """Packed ids by pre-token; a missing one goes through the BPE model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.characters = model, _byte_characters()

    def __missing__(self, text: str) -> bytes:
        ids = packed([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.characters))])
        if len(text) <= LONGEST_CACHED:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.kind = self._kind(told)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.pre_tokens = _PreTokens(self.tokenizer.model)
        self.units: dict[str, bytes] = {}

    @staticmethod
    def _kind(told: dict) -> _Kind | None:
        pre, normal = told.get("pre_tokenizer") or {}, told.get("normalizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            return _SPACE_JOINED
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        kinds = [x.get("type") for x in normal.get("normalizers", [])]
        if steps == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"]:
            split = pre["pretokenizers"][0]
            if split.get("behavior") == "Removed" and split.get("invert") and not pre["pretokenizers"][1].get("add_prefix_space"):
                return _SPACE_DROPPED
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; a null text has none."""
        out: list[bytes] = []
        for a, b in megabytes_of(texts):
            part = [t or "" for t in texts[a:b]]
            odd = [t for t in part if self._odd(t)]
            done = iter(self._by_units(odd))
            out += [next(done) if odd and self._odd(t) else self._plain(t) for t in part]
        return out

    def _odd(self, text: str) -> bool:
        return self.kind is None or bool(_NOT_PLAIN.search(text) or _OTHER_SPACE.search(text)) or any(s in text for s in self.special)

    def _plain(self, text: str) -> bytes:
        cuts = self.kind.plain.findall(text.lower() if self.kind.lower else text)
        return b"".join(map(self.pre_tokens.__getitem__, cuts))

    def _by_units(self, texts: list[str]) -> list[bytes]:
        whole = [self.kind is None or bool(_OTHER_SPACE.search(t)) or any(s in t for s in self.special) for t in texts]
        cuts = [None if w else self.kind.unit.findall(t) for t, w in zip(texts, whole)]
        seen: set[str] = set().union(*(c for c in cuts if c))
        new = [u for u in seen if u not in self.units]
        if len(self.units) + len(new) > CACHE_UNITS:
            self.units, new = {}, list(seen)
        if new:
            self.units.update((u, packed(e.ids)) for u, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)))
        out = [
            packed(self.tokenizer.encode(t, add_special_tokens=False).ids) if c is None else b"".join([self.units[x] for x in c])
            for t, c in zip(texts, cuts)
        ]
        for u in new:
            if len(u) > LONGEST_CACHED:
                del self.units[u]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; a reused Python worker keeps its cache from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
