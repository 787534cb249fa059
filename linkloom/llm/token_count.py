r"""Token counts with a whole-token shortcut.

The vocabulary file's library defines the count. Merges never cross pre-tokens, so a text has as many
tokens as its pre-tokens have together. Offline, every vocabulary string that ends a word is encoded
alone; those that come out as one token are proven whole tokens and count as one wherever they are a
pre-token. Only other pre-tokens are merged, by the library itself, each once while it is remembered.

Pre-tokens never cross white space, so a text is taken in parts between it. A part with characters for
which this module's pre-tokeniser is not known to agree with the library's (beyond Latin letters, common
punctuation and plain white space), or with the start of a special token's string, is encoded by the
library as it stands, once while it is remembered; all other parts of such a text take the shortcut.

Defined cases: null and empty texts have no tokens and no bytes; texts of any length are counted whole;
ties do not arise; repeated rows give repeated rows; an empty table gives an empty table; only ``doc_id``
and ``text`` are read, so clashing names of other columns do no harm.
"""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
REMEMBERED = 600_000  # pre-tokens a worker keeps, besides the proven ones
#: Lower-cased letters and numbers below U+0180; the other classes follow from them.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t-\r{_LETTERS}{_NUMBERS}]+")
PART = re.compile("[^\t\n\r ]+")
UNSURE = re.compile("[^\t-\r -~\xa1-ſ‐-‧€]|İ|<\\|")
_BATCH = 128


def library(text: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def vocabulary_text(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens(tokenizer) -> list[str]:
    """Vocabulary strings that are one pre-token and that the library encodes, alone, as one token."""
    byte = _bytes_of_letters()
    found = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith("</w>") and all(c in byte for c in piece[:-4]):
            try:
                s = bytes(byte[c] for c in piece[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if not UNSURE.search(s) and PIECE.findall(s.lower()) == [s]:
                found.append(s)
    return sorted(s for s, e in zip(found, tokenizer.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts the tokens of texts; ``whole`` are the proven whole tokens."""

    def __init__(self, text: str, whole: list[str]):
        self.tokenizer = library(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)
        self.odd: dict[str, int] = {}
        self.letters = [c for _, c in sorted((b, c) for c, b in _bytes_of_letters().items())]

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> list[int]:
        """Tokens of pre-tokens: the library's merges alone, without its normaliser and offsets."""
        merge = self.tokenizer.model.tokenize
        return [len(merge(p if p.isascii() else "".join(self.letters[b] for b in p.encode()))) for p in pieces]

    def _pieces(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens of a text's sure parts, and its unsure parts."""
        if not UNSURE.search(text):
            return PIECE.findall(text.lower()), []
        parts = PART.findall(text)
        unsure = [p for p in parts if UNSURE.search(p)]
        return PIECE.findall(" ".join(p for p in parts if not UNSURE.search(p)).lower()), unsure

    def count(self, texts: list[str]) -> list[int]:
        found = [self._pieces(t) for t in texts]
        new = set().union(*(p for p, _ in found)) - self.known.keys()
        odd = set().union(*(u for _, u in found)) - self.odd.keys()
        if len(self.known) + len(new) > len(self.whole) + REMEMBERED:
            self.known = dict(self.whole)
            new = set().union(*(p for p, _ in found)) - self.known.keys()
        if len(self.odd) + len(odd) > REMEMBERED:
            self.odd, odd = {}, set().union(*(u for _, u in found))
        new, odd = list(new), list(odd)
        self.known.update(zip(new, self._merged(new), strict=True))
        self.odd.update(zip(odd, self._encoded(odd), strict=True))
        return [sum(map(self.known.__getitem__, p)) + sum(map(self.odd.__getitem__, u)) for p, u in found]


_COUNTERS: dict[int, Counter] = {}


def n_tokens(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """The library's number of tokens of a text, without begin, end or added special tokens."""
    vocabulary = vocabulary_text(path)
    shared = spark.sparkContext.broadcast((vocabulary, whole_tokens(library(vocabulary))))

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        key = hash(shared.value[0])
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*shared.value)
        return pd.Series([n for at in range(0, len(texts), _BATCH) for n in _COUNTERS[key].count([t or "" for t in texts.iloc[at : at + _BATCH]])], dtype="int64")

    return of(text)


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    text = C.text_of()
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(docs.sparkSession, text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(C.table(spark, sf_dir, "documents"))
