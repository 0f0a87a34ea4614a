"""Token ids of public tokenizers, word by word.

The tokenizer drops white space and never joins across it, so the ids of a text are those
of its words in order. Arrow cuts a batch of texts into words, in lower case, and numbers the different ones
(exactly, by a hash table); only these are looked up, and numpy puts the ids of all texts together.
Words are kept with their ids in a bounded memory: most words of a corpus repeat. Words of plain Latin letters, digits and signs are cut here by the
tokenizer's own pattern and given to the library's BPE model; all others go through the
library's whole encode().
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Longer words are seldom met again.
KEPT_LENGTH = 14
#: Bytes of text that are cut into words at once.
PIECE = 2 << 20
_GAP = re.compile("[ \t\n\r\x0b\x0c]")
#: A full stop or comma that ends a word.
_SIGN = r"([a-z])([.,](?:[ \t\n\r\x0b\x0c]|$))"
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_CUT = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters for bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    out.update({b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)})
    return out


@cache
def shared_encoder(path: str) -> Encoder:
    """One for all tasks that a Python worker runs, as they meet the same words."""
    return Encoder(path)


class Encoder(dict):
    """encode(text) gives the ids of a text as little-endian unsigned 32-bit integers.

    Words are kept in two generations of at most `most`: a full one becomes the old one, and what is asked for again moves on."""

    def __init__(self, path: str, most: int = 180_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self._whole = Tokenizer.from_file(path)
        self._bpe = self._whole.model.tokenize
        self._letters = _byte_letters()
        self._parts: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most = most

    def _part(self, part: str) -> bytes:
        if (out := self._parts.get(part)) is None:
            spelt = part if part.isascii() else "".join(map(self._letters.__getitem__, part.encode()))
            out = array("I", [x.id for x in self._bpe(spelt)]).tobytes()
            if len(part) <= KEPT_LENGTH:
                if len(self._parts) >= self._most // 4:
                    self._parts.clear()
                self._parts[part] = out
        return out

    def __missing__(self, word: str) -> bytes:
        out = self._old.get(word)
        if out is None:
            if word.isascii() and word.isalpha():
                out = array("I", [x.id for x in self._bpe(word)]).tobytes()
            elif _PLAIN.fullmatch(word):
                out = b"".join(map(self._part, _CUT.findall(word.lower())))
            else:
                out = array("I", self._whole.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a string column, one after another, as unsigned 32-bit integers; where each text starts among them, and the end). Null is an empty text; end_id follows each."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        # A copy of its own: lower-casing takes the first byte of a buffer for that of the column.
        column = pc.ascii_lower(column.take(pa.array(np.arange(len(column)))))
        upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        ids, sizes, i = [], [], 0
        while i < len(column):
            before = int(upto[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(upto, before + PIECE, side="right")))
            if upto[j - 1] - before > 2 * PIECE:  # a long text, by pieces that end where a word does
                parts = [self._encode(pa.array([x], pa.large_string()), None)[0] for x in _pieces(column[i].as_py())]
                found = np.concatenate([*parts, np.array([] if end_id is None else [end_id], np.uint32)])
                count = np.array([len(found)])
            else:
                found, count = self._encode(column.slice(i, j - i), end_id)
            ids.append(found)
            sizes.append(count)
            i = j
        return np.concatenate([*ids, np.empty(0, np.uint32)]), np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.empty(0, np.int64)])))).astype(np.int64)

    def _encode(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text)."""
        # The tokenizer lower-cases and cuts before a sign that follows a letter: done first, it leaves fewer different words.
        plain = pc.replace_substring_regex(column, _SIGN, r"\1 \2")
        words = pc.ascii_split_whitespace(plain)
        numbered = words.flatten().dictionary_encode()
        own = [self[w] for w in numbered.dictionary.to_pylist()]
        at = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:  # one more word at the end of each text
            at = np.insert(at, np.cumsum(lengths), len(own))
            own.append(int(end_id).to_bytes(4, "little"))
            lengths = lengths + 1
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        table, first = np.frombuffer(bytearray(b"".join(own)), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.repeat(first[at] - (ends - each), each) + np.arange(total)] if total else np.empty(0, np.uint32)
        return ids, np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))])


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = _GAP.search(text, at + PIECE)
        end = end.end() if end else len(text)
        yield text[at:end]
        at = end
