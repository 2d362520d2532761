"""Token ids of whole texts by the ``tokenizers`` library.

Encoding is split at places where no pre-token can cross: before a single space
that stands between two other characters, around a single line break, and between a
letter and a mark of ASCII. Each
distinct piece of some megabytes of texts is looked up once; it is encoded by the
library's model once and remembered, up to a bound. The result equals ``Tokenizer.encode`` on
the whole text (tests compare them on random texts).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex

from .words import _offsets, as_strings, text_chunks

END_ID = 0
MEMO = 400_000  # pieces in a generation of a task's memo, some 80 MB
CHUNK = 1 << 21  # bytes of texts that are cut into pieces at once
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned integers: of 16 bits
    if the vocabulary allows and ``narrow`` is set, else of 32."""

    def __init__(self, path: str, narrow: bool = False):
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.model._resize_cache(0)  # the memos take its place
        self.tokenize = tokenizer.model.tokenize
        size = tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if narrow and size <= 1 << 16 else "<u4")
        self.packed = [int(i).to_bytes(self.kind.itemsize, "little") for i in range(size)]
        self.end = END_ID.to_bytes(self.kind.itemsize, "little")
        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        shown = [self.letters[b].encode() for b in range(256)]
        self.shown = np.array([[x[0], x[-1]] for x in shown], np.uint8)  # bytes of each letter: one or two
        self.two = np.array([len(x) == 2 for x in shown])
        self.line_break = self._ids("\n")
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # a generation of pieces before

    def clear(self) -> None:
        """Forget all pieces: a task's memo goes with the task."""
        self.pieces, self.older = {}, {}

    def _pretoken(self, part: str) -> bytes:
        return self._packed(part.encode().decode("latin-1").translate(self.letters))

    def _packed(self, mapped: str) -> bytes:
        found = self.tokenize(mapped)
        packed = self.packed
        return packed[found[0].id] if len(found) == 1 else b"".join([packed[t.id] for t in found])

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self._pretoken, self.pretokens(text)))

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.large_string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (``large_string`` without nulls). Arrow tells the distinct
        pieces; each is looked up once."""
        offsets = _offsets(texts)
        if not len(texts) or offsets[0] == offsets[-1]:
            return [b""] * len(texts)
        data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0])
        raw, bounds = np.frombuffer(data, np.uint8), offsets - offsets[0]
        start, whole = _cuts(raw, bounds)
        parts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(raw))), data).dictionary_encode()
        found, at = self._found(parts.dictionary), parts.indices.to_numpy()
        odd = np.array([x is None for x in found])
        if odd.any():
            whole[np.searchsorted(bounds, start[odd[at]], side="right") - 1] = True
            found = [x or b"" for x in found]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        n, first = size[at], (np.cumsum(size) - size)[at]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), self.kind)[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.append(0, ends)[np.searchsorted(start, bounds)].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for d in np.flatnonzero(whole).tolist():
            out[d] = self._ids(texts[d].as_py())
        return out

    def _found(self, parts: pa.Array) -> list[bytes | None]:
        """Ids of distinct pieces; None where white space meets white space."""
        names = parts.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.pieces.get, names)]
        new = [k for k, x in enumerate(found) if x is None]
        mapped = self._mapped(parts.take(pa.array(new, pa.int64())))
        for k, shown in zip(new, mapped, strict=True):
            name = names[k]
            ids = self.older.get(name)
            if ids is None:
                if name.isalpha() or (name[0] == " " and name[1:].isalpha()):  # one pre-token
                    ids = self._packed(shown)
                elif name == "\n":
                    ids = self.line_break
                else:
                    part = name[1:] if name[0] == " " else name
                    if not part or part[0].isspace() or part[-1].isspace():
                        continue
                    ids = self._ids(name)
            if len(self.pieces) >= MEMO:
                self.older, self.pieces = self.pieces, {}
            found[k] = self.pieces[name] = ids
        return found

    def _mapped(self, parts: pa.Array) -> list[str]:
        """Pieces as byte-level vocabularies show them."""
        if not len(parts):
            return []
        offsets = _offsets(parts)
        raw = np.frombuffer(parts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        n = 1 + self.two[raw]
        ends = np.append(0, np.cumsum(n))
        out = np.empty(ends[-1], np.uint8)
        out[ends[:-1]] = self.shown[raw, 0]
        out[ends[1:] - 1] = self.shown[raw, 1]
        return pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(ends[offsets - offsets[0]]), pa.py_buffer(out)).to_numpy(zero_copy_only=False).tolist()


def _cuts(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in the bytes of consecutive texts (``bounds``), and which
    texts hold white space beside a space or line break, or begin or end with one."""
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True  # a text begins or ends here
    line, apart = raw == 0x0A, first.copy()
    gap = line | (raw == 0x20)
    bad = gap & first[1:]
    bad[1:] |= gap[:-1] & gap[1:]
    bad |= gap & first[:-1]
    whole = np.zeros(len(bounds) - 1, bool)
    if bad.any():
        whole[np.searchsorted(bounds, np.flatnonzero(bad), side="right") - 1] = True
    apart[:-1] |= gap
    apart[1:] |= line
    letter = _IS_LETTER[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # U+00C0 to U+00FF but two signs
    apart[1:-1] |= letter[:-1] & _IS_MARK[raw[1:]]
    return np.flatnonzero(apart[:-1]), whole


@functools.lru_cache(maxsize=2)
def encoder(path: str, narrow: bool = False) -> Encoder:
    return Encoder(path, narrow)


def encode_texts(texts: pa.Array, path: str, narrow: bool = False) -> list[bytes]:
    """Ids of each text with the end id last (null: the end id alone)."""
    own, texts = encoder(path, narrow), as_strings(texts)
    return [x + own.end for i, j in text_chunks(texts, CHUNK) for x in own.encode_all(texts.slice(i, j - i))]
