"""Token ids of a public tokenizer file, at the speed of a table of words.

Both kinds of file split a text before the merges run, at places that depend only on the
characters around them. A text is cut at single spaces and line feeds between other
characters, which always are such places; the ids of each part come from a table that the
tokenizers library's own model fills. A text where two white-space characters meet, or at
whose ends white space or a zero character stands, goes through the library as a whole; so
does one with a character that is not as old as Unicode 3.2, as libraries of different age
class, compose or lower-case such characters differently.

Of many texts at once the byte-level kind finds all pieces by the classes of neighbouring
characters, looks each distinct piece up once and runs the merges of those it lacks together.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of a worker's table (some 200 bytes each), and characters of a part that it may keep; any other part is computed each time.
TABLE, LONGEST = 1_200_000, 40
#: Entries of a table that is renewed, for workers beside an executor that other stages have filled.
SMALL = 400_000
#: Characters of a text that is encoded together with others, and pieces whose merges run in one call.
SHORT, AT_ONCE = 1 << 20, 256
#: The byte-level alphabet, bytes that stand for themselves and then the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_BYTES = "".join(_ALPHABET[b] for b in range(256))
#: How the two kinds of file split a text.
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD = re.compile(r"\s\s|\0")
#: A byte that no UTF-8 text has; the alphabet's code points, where the zero byte stands for that one.
_APART = _ALPHABET[255]
_CODES = np.array([ord(c) for c in _APART + _BYTES[1:]], "<u4")
#: Classes of characters, 0 for those that are not stable.
_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 3, 4


@cache
def stable_characters() -> frozenset[str]:
    """Characters whose class and case no library disagrees on: those of Unicode 3.2, without odd white space and controls."""
    old = unicodedata.ucd_3_2_0.category
    return frozenset(c for c in map(chr, range(0x110000)) if c in "\n " or old(c)[0] not in "CZ") - {"İ", "Σ"}


@cache
def character_classes() -> np.ndarray:
    """Code point -> its class."""
    out = np.zeros(0x110000, np.uint8)
    stable = "".join(stable_characters())
    for kind, own in ((_OTHER, stable), (_LETTER, "".join(regex.findall(r"\p{L}", stable))), (_NUMBER, "".join(regex.findall(r"\p{N}", stable))), (_WHITE, " \n")):
        out[np.frombuffer(own.encode("utf-32-le"), "<u4")] = kind
    return out


class Unsure(Exception):
    """A part holds a character that is not stable."""


class _Parts(dict):
    """part -> its ids; what is missing is computed and kept while there is room."""

    def __init__(self, ids, size: int):
        self.ids, self.room = ids, size

    def __missing__(self, part: str) -> bytes:
        got = self.again(part)
        if got is None:
            got = self.ids(part)
        self.keep(part, got)
        return got

    def again(self, part: str) -> bytes | None:
        """The ids of a part that has left the table, if they are still known."""

    def keep(self, part: str, ids: bytes) -> None:
        if len(self) < self.room and len(part) <= LONGEST:
            self[part] = ids


class _Renewed(_Parts):
    """The same in less memory: a table of half the size that becomes the one before when it is full; a part that comes again is taken back from that."""

    def __init__(self, ids, size: int):
        super().__init__(ids, max(1, size // 2))
        self.before: dict[str, bytes] = {}

    def again(self, part: str) -> bytes | None:
        return self.before.get(part)

    def keep(self, part: str, ids: bytes) -> None:
        if len(part) <= LONGEST:
            if len(self) >= self.room:
                self.before = dict(self)
                self.clear()
            self[part] = ids


class Ids:
    """text -> ids as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, path: str, table: int = TABLE, renewed: bool = False):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.whole.get_vocab_size()
        self.model = self.whole.model
        self.marks = [t["content"] for t in spec.get("added_tokens", [])]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.lower, split = False, _BYTE_SPLIT
        elif [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _WORD_SPLIT} and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.lower, split = True, _WORD_SPLIT
        else:
            self.lower, split = False, None
        self.split = split and regex.compile(split).findall
        self.chunks = (_Renewed if renewed else _Parts)(self._chunk, table)
        own = spec["model"]
        alone = own["type"] == "BPE" and not any(own.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        alone = alone and not any(_APART in (m if isinstance(m, str) else "".join(m)) for m in own["merges"])
        #: The id of the byte that keeps pieces apart; none where no such byte would.
        self.apart = own["vocab"].get(_APART) if alone and split == _BYTE_SPLIT else None

    def _piece(self, piece: str) -> bytes:
        own = piece if piece.isascii() else piece.encode().decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(own.translate(_BYTES))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and (chunk[1:] if chunk[:1] == " " else chunk).isalpha():  # one piece
            return self._piece(chunk)
        if not stable_characters().issuperset(chunk):
            raise Unsure
        pieces = self.split(chunk)
        return b"".join([self.chunks[p] for p in pieces]) if len(pieces) > 1 else self._piece(chunk)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. They stand in one string with a byte between them that is in no merge, so merges run in each as if it stood alone, and that byte's id tells where the next begins."""
        out = []
        for i in range(0, len(pieces), AT_ONCE):
            own = np.frombuffer("\0".join(pieces[i : i + AT_ONCE]).encode(), np.uint8)
            ids = np.array([t.id for t in self.model.tokenize(_CODES[own].tobytes().decode("utf-32-le"))], "<u4")
            flat, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.apart)).tolist()
            out += [flat[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(flat)], strict=True)]
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; equal to a call for each."""
        if self.apart is None:
            return [self(t) for t in texts]
        own = [i for i, t in enumerate(texts) if len(t) <= SHORT and not any([m in t for m in self.marks])]
        whole = "\0".join(["", *[texts[i] for i in own], ""])
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kind = character_classes()[codes]
        ends = np.cumsum([len(texts[i]) + 1 for i in own], dtype=np.int64)
        gap = (kind == 0) | (kind == _WHITE)
        strange = kind == 0
        strange[0], strange[ends] = False, False
        strange[1:] |= gap[1:] & gap[:-1]  # white space that meets white space or an end; an empty text
        off = set(np.searchsorted(ends, np.flatnonzero(strange)).tolist())
        if off or len(own) < len(texts):
            good = [i for k, i in enumerate(own) if k not in off]
            done = dict(zip(good, self.many([texts[i] for i in good]) if good else [], strict=True))
            return [done[i] if i in done else self(t) for i, t in enumerate(texts)]
        return self._together(whole, codes, kind)

    def _together(self, whole: str, codes: np.ndarray, kind: np.ndarray) -> list[bytes]:
        """Ids of texts of stable characters, with a zero character before, between and after them, and no white space beside white space or at an end."""
        begins = np.ones(len(codes), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (codes[:-1] != 32)  # a space is the begin of what follows
        quote = np.flatnonzero((codes == 39) & begins)
        next_, after = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        one = quote[np.isin(next_, [ord(c) for c in "stmd"])]
        two = quote[((after == ord("e")) & np.isin(next_, [ord("r"), ord("v")])) | ((next_ == ord("l")) & (after == ord("l")))]
        begins[one + 1], begins[two + 1] = False, False
        begins[one + 2], begins[two + 3] = True, True
        at = np.flatnonzero(begins)
        data = whole.encode()
        if len(data) > len(codes):
            width = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
            at = (np.cumsum(width) - width)[at]
        places = np.append(at, len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        of, n = found.indices.to_numpy(), len(found.dictionary)
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), found.dictionary), "\1")[0].as_py().split("\1")
        table = self.chunks
        got = list(map(table.get, distinct))
        got[0] = b""  # the zero character is the first piece
        lacking = []
        for i in [i for i, g in enumerate(got) if g is None]:
            got[i] = table.again(distinct[i])
            if got[i] is None:
                lacking.append(i)
            else:
                table.keep(distinct[i], got[i])
        for i, ids in zip(lacking, self._pieces([distinct[i] for i in lacking]), strict=True):
            got[i] = ids
            table.keep(distinct[i], ids)
        size = np.fromiter(map(len, got), np.int64, n) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        sizes = size[of]
        upto = np.cumsum(sizes)
        ids = flat[np.arange(upto[-1]) + np.repeat((np.cumsum(size) - size)[of] - upto + sizes, sizes)].tobytes()
        ends = (4 * upto[of == 0]).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _plainly(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.split is None or any([m in text for m in self.marks]):
            return self._plainly(text)
        if self.lower:
            own = text if text.isascii() else unicodedata.normalize("NFC", text)
            if "Σ" in own or "İ" in own:  # capitals that Python lower-cases by what stands around them
                return self._plainly(text)
            parts = own.lower().replace("\n", " ").split(" ")
        elif text[0].isspace() or text[-1].isspace() or _ODD.search(text):
            return self._plainly(text)
        else:
            parts = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        try:
            return b"".join(map(self.chunks.__getitem__, parts))
        except Unsure:
            return self._plainly(text)


_LOADED: dict[tuple[str, bool], Ids] = {}


def ids_of(path: str, small: bool = False) -> Ids:
    """One instance a worker process; a small one has a table of SMALL entries that is renewed."""
    if (path, small) not in _LOADED:
        _LOADED[path, small] = Ids(path, SMALL, True) if small else Ids(path)
    return _LOADED[path, small]
