"""Operator 6: byte-level BPE with the tokenizers library over Arrow batches, and its inverse.

A rank file lists byte strings by merge order. The library's BPE model works on characters, so each byte is
mapped to a printable character (the byte table below), the merges are all splits of a token into two tokens, in rank
order, and a piece that is itself a token is taken whole. Decoding maps ids to byte strings by the reversed
table and joins them; a character that is split over tokens comes together again, and what is no valid UTF-8
by itself becomes U+FFFD in the decoded *text* only, never in the decoded bytes. The offsets of the tokens are where each ends in its
text, in code points.

Results in special cases. Null or empty text: no tokens, no bytes. Empty table: no rows. Very long texts: whole, one at a time. Repeated rows, equal or
null doc_ids: each row by itself. Other columns are kept; `ids`, `n_tokens`, `token_ends`, `decoded` and `decoded_text` replace
columns of these names.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small

#: Pieces whose ids a worker remembers; beyond that it forgets the newer ones.
REMEMBERED = 300_000
#: The usual byte-level pattern. Texts of certain characters only are split by one that `re` runs fast, whose classes equal
#: those of the full pattern for these characters. Any other pattern is used as it is.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


def byte_table() -> dict[int, str]:
    """A printable character for each byte: itself where printable, else the next free ones from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_tokenizer(ranks: dict[bytes, int]):
    """A Tokenizer whose model encodes one piece, mapped to characters, by the ranks."""
    from tokenizers import Tokenizer, models

    chars = byte_table()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(name[token[:i]], name[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    model = models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
    return Tokenizer(model)


class _Known(dict):
    """Ids of pieces, as bytes; a piece that is missing goes to the library's BPE model, byte by character."""

    def __init__(self, model):
        self.model, self.chars = model, byte_table()

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.chars)
        out = self[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return out


class PieceEncoder:
    """Ids of texts as little-endian 32-bit integers; a piece goes to the library when it is new to this worker.

    pieces: a compiled pattern; without one the tokenizer splits texts. quick: the pattern is the usual one. special: strings that the
    tokenizer treats as one token each.
    """

    def __init__(self, tokenizer, pieces=None, quick: bool = False, special: tuple[str, ...] = ()):
        self.tokenizer, self.pieces, self.quick, self.known = tokenizer, pieces, quick, _Known(tokenizer.model)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def split(self, text: str) -> list[str] | None:
        if self.quick and _PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            return _PLAIN_PIECES.findall(text)
        return self.pieces.findall(text) if self.pieces else None

    def ids(self, text: str) -> bytes:
        found = self.split(text)
        if found is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > REMEMBERED:  # frequent pieces came first, so the oldest third stays
            oldest = list(islice(self.known.items(), REMEMBERED // 3))
            self.known.clear()
            self.known.update(oldest)
        return b"".join(map(self.known.__getitem__, found))


def _one_thread() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> PieceEncoder:
    _one_thread()
    import regex

    return PieceEncoder(rank_tokenizer(read_ranks(path)), regex.compile(pattern), pattern == USUAL)


@lru_cache(maxsize=2)
def file_encoder(path: str) -> PieceEncoder:
    """The ids that the tokenizer file gives without adding special tokens; those that a text spells out are single tokens, as there."""
    _one_thread()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    state = json.loads(tokenizer.to_str())
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    splits = {k: v for k, v in (state["pre_tokenizer"] or {}).items() if k in usual}
    plain = not any(state[k] for k in ("normalizer", "truncation", "padding")) and state["model"]["type"] == "BPE" and not state["model"].get("dropout")
    return PieceEncoder(tokenizer, None, plain and splits == usual, tuple(a["content"] for a in state["added_tokens"]))


@lru_cache(maxsize=2)
def byte_strings(path: str) -> list[bytes]:
    """The byte string of each id, by the reversed byte table."""
    chars = byte_table()
    back = {c: b for b, c in chars.items()}
    out = [b""] * (1 + max((ranks := read_ranks(path)).values()))
    for token, i in ranks.items():
        name = "".join(chars[b] for b in token)  # as the model spells it
        out[i] = bytes(back[c] for c in name)
    return out


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def token_ends(ids: bytes, table: list[bytes]) -> list[int]:
    """Where each token ends in its text, in code points: a split character belongs to its last token."""
    data = decode_ids(ids, table)
    sizes = np.array([len(table[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    begun = np.concatenate(([0], np.cumsum(lead)))
    ends = np.cumsum(sizes)
    whole = np.concatenate((lead, [True]))[ends]  # what follows starts a character
    return (begun[ends] - ~whole).tolist()


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """docs with n_tokens and ids (32-bit little-endian) of each text, with offsets also token_ends."""
    docs = docs.drop("ids", "n_tokens", "token_ends")
    schema = docs.selectExpr("*", "0L n_tokens", "binary('') ids", *(["array(0) token_ends"] if offsets else [])).schema

    def run(batches):
        encoder = rank_encoder(path, pattern)
        for batch in small(batches):
            ids = [encoder.ids(t or "") for t in batch.column("text").to_pylist()]
            more = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if offsets:
                table = byte_strings(path)
                more.append(pa.array([token_ends(x, table) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *schema.names[len(batch.schema.names) :]])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, text: bool = False) -> DataFrame:
    """encoded with decoded (bytes) for its ids, with text also decoded_text."""
    encoded = encoded.drop("decoded", "decoded_text")
    schema = encoded.selectExpr("*", "binary('') decoded", *(["'' decoded_text"] if text else [])).schema

    def run(batches):
        table = byte_strings(path)
        for batch in small(batches):
            data = [decode_ids(x or b"", table) for x in batch.column("ids").to_pylist()]
            more = [pa.array(data, pa.binary())] + ([pa.array([x.decode("utf-8", "replace") for x in data], pa.string())] if text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Ids and decoded bytes of each text, with offsets also token_ends; the texts themselves stay behind."""
    encoded = encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, pattern, offsets)
    return decode(encoded.drop("text"), path)
