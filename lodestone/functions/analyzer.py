"""Text analysis: normalise, cut at word boundaries, lower-case, drop, stem; positions count kept segments before stop words go."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stemmer

try:
    import regex
except ImportError:  # word boundaries of Unicode are then refused, never replaced by other ones
    regex = None

UNICODE = unicodedata.unidata_version
LONGEST = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Analyzers by name: what cuts a text into segments, of which those that are no words are left out.
REGISTERED: dict[str, Callable[[str], list[str]]] = {}


def register(name: str, cut: Callable[[str], list[str]]) -> None:
    """An analyzer of one's own: cut gives the words of a normalised text. Lower case, stop words and stems are as ever."""
    if REGISTERED.setdefault(name, cut) is not cut:
        raise ValueError(f"there is an analyzer {name!r}")


def normalise(text: str, form: str = "NFKC") -> str:
    return unicodedata.normalize(form, text)


def segments(text: str) -> list[str]:
    """Segments between Unicode word boundaries."""
    return [s for s in regex.split(r"(?V1w)\b", text) if s]


def is_word(segment: str) -> bool:
    """Whether some sign is alphabetic or numeric."""
    return bool(regex.search(r"[\p{Alphabetic}\p{N}]", segment)) or any(unicodedata.numeric(c, None) is not None for c in segment)


def words(text: str) -> list[str]:
    return [s for s in segments(text) if is_word(s)]


def lower(text: str) -> str:
    """Simple lower-casing of each code point, whatever stands next to it."""
    return "".join("i" if c == "İ" else low if len(low := c.lower()) == 1 else c for c in text)


@dataclass(frozen=True)
class Analyzer:
    """name, Unicode version and stemmer release are pinned: what isn't there is refused, never replaced."""

    stopwords: frozenset[str] = frozenset()
    stem: str | None = None
    stem_version: str | None = None
    positions: bool = True
    name: str = "std.v1"
    unicode_version: str = UNICODE
    _stops: frozenset[str] = field(init=False, repr=False, default=frozenset())
    _cut: Callable[[str], list[str]] | None = field(init=False, repr=False, default=None)

    def __post_init__(self):
        if self.name == "std.v1" and regex is None:
            raise ValueError("std.v1 needs the package regex")
        if self.name not in ("std.v1", *REGISTERED):
            raise ValueError(f"no analyzer {self.name!r} is registered here")
        object.__setattr__(self, "_cut", REGISTERED.get(self.name))
        if self.unicode_version != UNICODE:
            raise ValueError(f"the text was analysed with Unicode {self.unicode_version}; here is {UNICODE}")
        if self.stem is not None and (self.stem != "english" or self.stem_version != stemmer.VERSION):
            raise ValueError(f"no stemmer {self.stem!r} of release {self.stem_version!r}; there is 'english' of {stemmer.VERSION}")
        object.__setattr__(self, "_stops", frozenset(lower(normalise(s)) for s in self.stopwords))

    def analyze(self, text: object) -> list[tuple[str, int]]:
        """(token, position); what is no text has none."""
        if not isinstance(text, str):
            return []
        out, position = [], -1
        for segment in (self._cut or words)(normalise(text)):
            position += 1
            token = lower(segment)
            if len(token) > LONGEST or token in self._stops:
                continue
            token = stemmer.stem(token) if self.stem else token
            if token:
                out.append((token, position))
        return out


def tokens(df: DataFrame, id_col: str, fields: list[str], analyzer: Analyzer, base: int = 1 << 20) -> DataFrame:
    """_id, token, position of every kept token; a later field's positions start at the next multiple of base."""
    inputs = [F.col(f"`{id_col}`").alias("_id"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, places = [], [], []
            for row, texts in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns)))):
                for i, text in enumerate(texts):
                    for token, position in analyzer.analyze(text):
                        ids.append(row)
                        words.append(token)
                        places.append(i * base + position)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(words, pa.string()), pa.array(places, pa.int32())], names=["_id", "token", "position"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(*inputs).mapInArrow(run, f"_id {kind}, token string, position int")


def ascii_tokens(df: DataFrame, id_col: str, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """The same for texts of plain ASCII words, by DataFrame functions: runs of ASCII letters and digits, lower-cased."""
    words = F.filter(F.split(F.translate(F.col(f"`{text}`"), UPPER, UPPER.lower()), "[^a-z0-9]+"), lambda w: w != "")
    out = df.select(F.col(f"`{id_col}`").alias("_id"), F.posexplode(words).alias("position", "token")).where(F.length("token") <= LONGEST)
    if stopwords:
        out = out.where(~F.col("token").isin(*stopwords))
    return out.select("_id", "token", "position")
