"""Token ids of a whole corpus by a byte-level BPE vocabulary.

A sentencepiece BPE model is serialised directly from the vocabulary file: each token's bytes are
mapped to printable characters, its score is minus its rank, and the normaliser is the identity.
Text is cut into pre-tokens by the tokenizer's own pattern, each pre-token is byte-mapped and
encoded by that model, and decoding maps the pieces back to bytes.

Most of the work is recognising words that were seen before. A text is cut at its single spaces,
where the pattern always starts a new pre-token; a worker keeps the ids of the chunks it has seen,
and the ids of a batch are gathered with numpy from the chunks' codes.

Null and empty texts have no ids (an empty list). Strings that look like special tokens are
ordinary text. Texts are used whole, whatever their length.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bandlens.plans.ship import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's published pattern for pre-tokens (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which \w, \d and \s of the standard library mean the same as the classes above.
PLAIN = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: Characters outside the blocks for which that was verified.
UNUSUAL = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿]")
#: White space next to a space; without it (and without unusual characters) every space starts a pre-token.
RUNS = ("  ", " \n", "\n ", " \r", "\r ", " \t", "\t ")
#: Chunks a worker remembers before it starts anew.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        n &= 2**64 - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    head = varint(number << 3 | kind)
    if kind == 0:
        return head + varint(value)
    return head + (varint(len(value)) if kind == 2 else b"") + value


def sentencepiece_model(vocabulary: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the vocabulary's ranks; one unknown piece comes last."""
    chars = byte_characters()
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for token, rank in vocabulary.items():
        text = "".join(chars[b] for b in token).encode()
        pieces[rank] = _field(1, 2, _field(1, 2, text) + _field(2, 5, struct.pack("<f", -rank)))
    for rank, piece in enumerate(pieces):
        if not piece:  # an unused rank must still take its place
            pieces[rank] = _field(1, 2, _field(1, 2, f"<unused {rank}>".encode()) + _field(2, 5, struct.pack("<f", -1e9)) + _field(3, 0, 5))
    pieces.append(_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0)) + _field(3, 0, 2)))
    trainer = _field(3, 0, 2) + _field(4, 0, len(pieces)) + _field(40, 0, len(pieces) - 1) + b"".join(_field(n, 0, -1) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normaliser)


class _Codes(dict):
    """Gives each key the next number when it is first asked for, and lists it as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class Encoder:
    """Encodes and decodes with a serialised model; keeps the ids of chunks it has seen."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chars = byte_characters()
        self.table = {b: c for b, c in enumerate(self.chars)}
        self.back = {c: b for b, c in enumerate(self.chars)}
        self.any = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def pretokens(self, text: str) -> list[str]:
        return (self.any if UNUSUAL.search(text) else PLAIN).findall(text)

    def chunks(self, text: str) -> list[str]:
        """Pieces that can be encoded one by one, as keys: without a leading space, or else after a line feed."""
        if UNUSUAL.search(text) or any(r in text for r in RUNS):
            return [p[1:] if p[0] == " " and p[1:2] != "\n" else "\n" + p for p in self.pretokens(text)]
        parts = text.split(" ")
        if parts[0]:
            parts[0] = "\n" + parts[0]
            return parts
        return parts[1:]

    def learn(self, keys: list[str]) -> None:
        """Encode the chunks that were met for the first time."""
        pre = [self.pretokens(k[1:] if k[:1] == "\n" else " " + k) for k in keys]
        mapped = [p.encode().decode("latin-1").translate(self.table) for ps in pre for p in ps]
        encoded = self.sp.encode(mapped)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, pre)])]
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends[1:]])
        self.ids = np.concatenate([self.ids, np.fromiter((i for e in encoded for i in e), np.int32, int(ends[-1]))])

    def coded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all chunks of all texts, and for each text how many they are."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        code, none = self.codes.__getitem__, np.zeros(0, np.int64)
        parts = [np.fromiter(map(code, self.chunks(t)), np.int64) if t else none for t in texts]
        if self.codes.new:
            self.learn(self.codes.new)
            self.codes.new = []
        return np.concatenate([none, *parts]), np.fromiter(map(len, parts), np.int64, len(parts))

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        codes, counts = self.coded(texts)
        sums = np.concatenate([[0], np.cumsum(np.diff(self.starts)[codes])])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the offsets at which each text's ids begin and end."""
        codes, counts = self.coded(texts)
        lengths = np.diff(self.starts)[codes]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[at], offsets

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 come out as U+FFFD."""
        pieces = "".join(self.sp.id_to_piece(int(i)) for i in ids)
        return bytes(self.back[c] for c in pieces).decode("utf-8", "replace")


_encoders: dict[bytes, Encoder] = {}


def _worker(model) -> Encoder:
    """The encoder of this Python worker, kept between tasks; another model replaces it."""
    value = model.value
    if value not in _encoders:
        _encoders.clear()
        _encoders[value] = Encoder(value)
    return _encoders[value]


def _model(df: DataFrame, vocabulary: str):
    ship(df.sparkSession)
    # A vocabulary is a file of fixed size (about a megabyte), so executors need no copy of it.
    return df.sparkSession.sparkContext.broadcast(sentencepiece_model(read_vocabulary(vocabulary)))


def _blocks(texts: list[str | None], characters: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about so many characters."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= characters:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>): one row for each row of ``df``, repeated rows and null keys too."""
    model = _model(df, vocabulary)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            encoder = _worker(model)
            for a, b in _blocks(texts):
                ids, offsets = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` and ``n_tokens`` (long): one row for each row of ``df``; 0 for a null or empty text."""
    model = _model(df, vocabulary)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            n = np.concatenate([np.zeros(0, np.int64), *[_worker(model).lengths(texts[a:b]) for a, b in _blocks(texts)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("n_tokens", T.LongType())])
    return df.select(*columns, text).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``text``, the inverse of :func:`encode_corpus`; no ids (an empty or null list) give an empty text."""
    model = _model(df, vocabulary)

    def run(batches):
        for batch in batches:
            texts = [_worker(model).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])
    return df.select(key, ids).mapInArrow(run, schema)
