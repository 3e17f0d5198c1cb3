"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one BPE encoding, so exactly one last
token. Going through a piece once, an automaton over all tokens yields, for
each prefix, the tokens that end there; the last token is the one that is
compatible with the last token of what stands before it. Following these
back-pointers from the end emits the ids. Time is linear in the piece for a
fixed vocabulary, whatever the merges.

Two tokens are compatible if BPE, run over their joined bytes, ends with just
the two. That is seen by undoing their merges from the last one backwards and
asking each time whether a merge across the border would have come first.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.rows import with_text_results

_SPACE = r"\t-\r \x85\xa0  -     　"
#: The published split pattern of byte-level BPE, with white space spelled out.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Where a space is not the first character of a piece that ends before the next space.
_ODD = re.compile(rf"^ | (?:[{_SPACE}]|\Z)")

#: Entries of a cache that are in use at a time, and as many of before; longer chunks are not kept.
CACHED, CACHED_CHARS = 200_000, 64


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Cache(dict):
    """Values made on demand, kept for keys that ``keeps`` accepts. Beyond ``most`` of them (CACHED by default) it starts anew, and takes over what is asked for again of those before."""

    def __init__(self, make, most: int | None, keeps=lambda chunk: len(chunk) <= CACHED_CHARS):
        self.make, self.most, self.keeps = make, most, keeps
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if self.keeps(key):
            if len(self) >= (self.most or CACHED):
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes and decodes by the vocabulary in ``source``, the text of a tokenizers JSON file."""

    def __init__(self, source: str, cached: int | None = None):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE with the standard split, without prefix space or normaliser")
        letters = _byte_letters()
        text = lambda token: bytes(letters[c] for c in token)
        ids = {text(token): i for token, i in model["vocab"].items()}
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("a vocabulary without a token for each byte")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or need word borders are not handled")
        # tables of numbers by token: a worker keeps them for its life
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of: list[bytes | None] = [None] * size
        for token, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = token
        self.merges = len(model["merges"])
        self.merge: dict[int, int] = {}  # pair: rank
        self.rank, self.left, self.right = (array("i", [-1]) * size for _ in range(3))  # of the merge that makes a token
        for rank, pair in enumerate(model["merges"]):
            left, right = (ids[text(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[self.bytes_of[left] + self.bytes_of[right]]
            self.merge[left << 32 | right] = rank
            if self.rank[made] >= 0:
                raise ValueError("a token with two merges")
            self.rank[made], self.left[made], self.right[made] = rank, left, right
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.fits = _Cache(lambda key: self.compatible(key >> 32, key & 0xFFFFFFFF), cached, lambda key: True)
        self.pieces = _Cache(lambda piece: self._tokens(piece.encode("utf-8")), cached)
        self.chunks = _Cache(self._chunk, cached)
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE over the two tokens' joined bytes gives these two tokens."""
        # a merge across the border that comes before `bound` would have been made; at equal ranks the leftmost is first
        bound = (self.merges, 0)
        while True:
            across = self.merge.get(left << 32 | right)
            if across is not None and (across, 1) < bound:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # undo the later of the two last merges; of equal ones the right token's, which was made last
            if a > b:
                bound, left = (a, 0), self.right[left]
            else:
                bound, right = (b, 2), self.left[right]

    def _tokens(self, piece: bytes) -> bytes:
        """The ids of one piece, as little-endian 32-bit integers."""
        last = [-1] * (len(piece) + 1)
        size = [0] * (len(piece) + 1)
        fits = self.fits
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if length == end:
                    last[end], size[end] = token, length
                else:
                    before = last[end - length]
                    if before >= 0 and fits[before << 32 | token]:
                        last[end], size[end] = token, length
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return array("I", out).tobytes() if _LITTLE else b"".join(x.to_bytes(4, "little") for x in out)

    def _chunk(self, chunk: str) -> bytes:
        """The ids of what stands between two spaces, the first one included."""
        first, *rest = _PIECE.findall(" " + chunk)
        if rest:
            return b"".join(map(self.pieces.__getitem__, [first, *rest]))
        return self._tokens(first.encode("utf-8"))  # the chunk is kept, so the piece need not be

    def _plain(self, text: str) -> bytes:
        if _ODD.search(text):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))
        first, *rest = text.split(" ")  # from here on, each space starts a piece
        return b"".join([*map(self.pieces.__getitem__, _PIECE.findall(first)), *map(self.chunks.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, packed as little-endian unsigned 32-bit integers."""
        if self._special_at is None or not self._special_at.search(text):
            return self._plain(text)
        parts = self._special_at.split(text)
        return b"".join(self.special[x].to_bytes(4, "little") if i % 2 else self._plain(x) for i, x in enumerate(parts) if x)

    def decode(self, ids: bytes) -> str:
        numbers = memoryview(ids).cast("I") if _LITTLE else [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


_LITTLE = memoryview((1).to_bytes(4, "little")).cast("I")[0] == 1 and array("I").itemsize == 4
_BUILT: dict[str, Encoder] = {}


def built(source: str, cached: int | None = None) -> Encoder:
    """The encoder for ``source``, kept for the life of the Python worker."""
    key = f"{cached}:{hashlib.sha256(source.encode()).hexdigest()}"
    if key not in _BUILT:
        _BUILT[key] = Encoder(source, cached)
    return _BUILT[key]


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str] | None = None, check: bool = False, cached: int | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` (their text).

    With ``check`` there is ``round_trip`` instead of ``decoded``: whether the
    decoded text is the text, so that it need not be sent back. ``cached``
    bounds what a worker remembers, which changes time and memory only.
    ``path`` names a tokenizers JSON file on the driver; its text (some MB,
    fixed by the vocabulary) is broadcast. Null and empty texts have no ids
    and decode to the empty text. The strings of added tokens become their ids
    wherever they stand. Columns of the input with the new names are
    replaced, all others stay as they are, whatever their names. Rows are
    handled one by one: repeated rows give equal results, an empty table an
    empty one.
    """
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(texts: list[str | None]) -> list[list]:
        encoder = built(source.value, cached)
        ids = [encoder.encode(x or "") for x in texts]
        decoded = map(encoder.decode, ids)
        return [ids, [a == (b or "") for a, b in zip(decoded, texts)] if check else list(decoded)]

    second = {"round_trip": ("boolean", pa.bool_())} if check else {"decoded": ("string", pa.string())}
    return with_text_results(docs, text_col, {"ids": ("binary", pa.binary())} | second, run, keep)
