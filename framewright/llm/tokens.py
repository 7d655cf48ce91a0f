"""Token ids of whole texts, by a public tokenizer of words, kept as a table that later passes read."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import kept, materialize, text_slices, utf8_rows

#: Id after each document.
END = 1
#: Words of which a worker remembers the ids, of up to so many bytes; beyond that it starts anew.
REMEMBERED, LONGEST = 1_000_000, 64
#: Words that are remembered at once. Most others are met once, so of them only those that come again are, told by so many marks by hashes.
AT_ONCE, MARKS = 1 << 16, 1 << 22
#: Tasks that write the table: the sums of a source by task are planned on the driver.
MOST_PARTS = 32_768
_LATIN = [chr(i) for i in range(0x250)]
_LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
#: What the tokenizer's own pattern finds in lower-case Latin text.
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_LEAVING = "".join(c for c in _LATIN if ord(c.lower()[0]) >= len(_LATIN))
#: Words that go to the tokenizer as they are: beyond Latin letters or with one whose small letter is, or with the mark of a special token.
_OTHER = re.compile(f"[^\x00-įı-ɏ]|[{_LEAVING}]|<\\||[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Ids of words between white space, as bytes of unsigned 16 or 32 bits; remembers those that come again.

    White space always parts the tokenizer's pieces, so the ids of a text are those of its words in a row.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.spelled, self.marks, self.marked = byte_letters(), bytearray(MARKS), 0
        self.plain = self.model.__class__.__name__ == "BPE" and self._alike()

    def _alike(self) -> bool:
        """Whether the tokenizer cuts words as this class does; if not, every new word goes to it whole."""
        probe = "Don't STOP, naïve-Größe x2²½ !?. a'llé 12ab's ÀÉ… ʼn"
        self.plain = True
        got = b"".join(self._ids(w) for w in probe.encode().split())
        self.clear()
        return list(np.frombuffer(got, self.dtype)) == self.tokenizer.encode(probe, add_special_tokens=False).ids

    @property
    def dtype(self) -> str:
        return "<u2" if self.code == "H" else "<u4"

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain and word.isalpha() and word.islower():
            return self._whole(text)
        if not self.plain or _OTHER.search(text):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = _PIECE.findall(text.lower())
        if pieces != [text]:
            # Alone, a piece is a word that is cut no further.
            return b"".join([self[piece.encode()] for piece in pieces])
        return self._whole(text if text.isascii() and text.isprintable() else word.decode("latin-1").translate(self.spelled))

    def _whole(self, spelled: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self._ids(word)
        if len(word) > LONGEST:
            return ids
        at = hash(word) % MARKS
        if self.marks[at] or len(self) < AT_ONCE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
            return ids
        if self.marked >= MARKS // 2:
            self.marks, self.marked = bytearray(MARKS), 0
        self.marks[at] = 1
        self.marked += 1
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    own = kept("tokens")
    if path not in own:
        own[path] = WordEncoder(path)
    return own[path]


def token_table(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, source, part, before, n, ids): ids of every whole text and the id `end`, written to the shared folder.

    ids are zstandard-compressed; part is the task that made the row, before the ids of the same source that the task
    had made until then. Null texts are empty and have the end id alone; repeated rows stay.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, made = encoder(path), {}
        part_id = TaskContext.get().partitionId()
        last, pack = array(enc.code, [end]).tobytes(), zstandard.ZstdCompressor(level=1)
        width = len(last)
        for batch in batches:
            for part in text_slices(batch):
                ids = [enc.encode(t) + last for t in utf8_rows(part.column("text"))]
                before = []
                for s, x in zip(part.column("source").to_pylist(), ids, strict=True):
                    before.append(made.get(s, 0))
                    made[s] = before[-1] + len(x) // width
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array([part_id] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())], ["doc_id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return materialize(rows.coalesce(MOST_PARTS).mapInArrow(run, "doc_id long, source string, part int, before long, n long, ids binary"), "token-ids")


def id_type(path: str | None = None) -> str:
    return encoder(path or default_path()).dtype
