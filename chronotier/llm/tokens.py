"""Encoding of texts with a public byte-level BPE vocabulary, exact for texts of any length.

A text of ordinary length is encoded as a whole. A long one is halved until its pieces are short; the pieces are encoded
in parallel, wherever the cuts fell, and joined pairwise up a tree: the tokens around a cut are encoded again, in windows
that grow until both ends of the window agree with the tokens already there.

When do they agree? The pattern that splits a text before the merges always ends a run of letters or digits where another
kind of character follows, and always splits before a white space that follows anything else. A cut of the tokens at such
a place is right whatever stands around it, so a window between two such places is right too. In a run of one kind no such
place exists; there, byte-pair encoding is right if each token and its neighbour are what the two encode to together, which
holds inside the window and outside of it, and at its ends if the window's outer tokens are the ones that were there.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters above which a text is halved, and above which a half is halved again.
LONG, PIECE = 16_384, 8_192
#: Tokens on either side of a cut that the first window takes, and tokens that must agree at each of its ends.
WINDOW, AGREE = 16, 4

_LOADED: dict[str, Tokens] = {}


class Tokens:
    """A vocabulary loaded once a process, with the bytes of each token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # Byte-level vocabularies write the 188 printable bytes as themselves and the others from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(printable)]
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes[i] = bytes(alphabet[c] for c in token)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def load(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def halves(text: str, piece: int = PIECE) -> list[str]:
    """The text cut in half until no piece is longer than ``piece`` characters."""
    if len(text) <= piece:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], piece) + halves(text[middle:], piece)


def _kind(c: str) -> str:
    """``L``, ``N``, ``S`` for white space, ``O`` for the rest; ``?`` where Unicode versions may differ."""
    if c.isspace():
        return "S" if c in " \t\n\r" else "?"
    k = unicodedata.category(c)
    return "?" if k in ("Cn", "Cc", "Cf", "Zs", "Zl", "Zp") else k[0] if k[0] in "LN" else "O"


def certain(text: str, at: int) -> bool:
    """Whether every text that holds this one is split between the characters ``at - 1`` and ``at``."""
    a, b = _kind(text[at - 1]), _kind(text[at])
    return "?" not in (a, b) and (b == "S" and a != "S" or a in "LN" and b != a)


def _settled(text: str, tokens: list[bytes]) -> bool:
    """Whether agreement on these tokens, which make up ``text``, is final."""
    if len({_kind(c) for c in text}) == 1 and "?" != _kind(text[0]):
        return True
    ends = set(np.cumsum([len(t) for t in tokens[:-1]]).tolist())
    place = 0
    for i, c in enumerate(text):
        if i and place in ends and certain(text, i):
            return True
        place += len(c.encode())
    return False


def _decoded(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def join(tok: Tokens, left: list[int], right: list[int]) -> list[int]:
    """Tokens of the concatenated text from the tokens of both parts."""
    k = WINDOW
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        # A window begins and ends between characters.
        while a > 0 and tok.bytes[left[a]][0] & 0xC0 == 0x80:
            a -= 1
        while b < len(right) and tok.bytes[right[b]][0] & 0xC0 == 0x80:
            b += 1
        ids = tok.encode(tok.text(left[a:] + right[:b]).decode())
        if (a == 0 or _agrees(tok, ids, left[a:], False)) and (b == len(right) or _agrees(tok, ids, right[:b], True)):
            return left[:a] + ids + right[b:]
        k *= 2


def _agrees(tok: Tokens, ids: list[int], there: list[int], at_end: bool) -> bool:
    """Whether the window's tokens agree with those that were there, from its outer end on, and finally so."""
    x, y = (ids[::-1], there[::-1]) if at_end else (ids, there)
    same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    while same >= AGREE:
        zone = [tok.bytes[i] for i in (x[:same][::-1] if at_end else x[:same])]
        if (text := _decoded(b"".join(zone))) is not None:
            return _settled(text, zone)
        same -= 1  # the zone ends inside a character
    return False


def join_all(tok: Tokens, pieces: list[list[int]]) -> list[int]:
    """Pairwise joins up a tree."""
    if not pieces:
        return []
    while len(pieces) > 1:
        pieces = [join(tok, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _replaced(batch: pa.RecordBatch, column: str, path: str) -> Iterator[pa.RecordBatch]:
    """The batch with ``ids`` in place of the text, in slices of bounded size."""
    tok, size = load(path), 512
    at = batch.schema.get_field_index(column)
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        ids = tok.encode_batch([t or "" for t in part.column(at).to_pylist()])
        names = [n for n in part.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [_lists(ids)], names=[*names, "__ids"])


def encode(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY, out: str = "ids", long: int = LONG, piece: int = PIECE) -> DataFrame:
    """``keep..., ids`` for each row; special tokens are never added, and their strings in a text are ordinary text.

    A null text and an empty one both get the empty list. Rows keep their number: repeated ones and null keys come out
    as they went in. Other columns, whatever their names, are left behind.
    """
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    kinds = dict(documents.dtypes)
    keys = ", ".join(f"k{i} {kinds[c]}" for i, c in enumerate(keep))
    rows = documents.select(*cols, F.col(text).alias("__text"))
    is_long = F.coalesce(F.length("__text") > long, F.lit(False))

    def whole(batches):
        for batch in batches:
            yield from _replaced(batch, "__text", vocabulary)

    short = rows.where(~is_long).mapInArrow(whole, f"{keys}, __ids array<int>")

    def cut(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                parts = halves(row[-1], piece)
                yield _frame(pdf, row, parts)

    names = [f"k{i}" for i in range(len(keep))]

    def _frame(pdf, row, parts):
        import pandas as pd

        return pd.DataFrame({**{c: pd.Series([v] * len(parts), dtype=pdf[c].dtype) for c, v in zip(names, row, strict=False)}, "__row": row[len(names)], "__no": range(len(parts)), "__text": parts})

    def grow(pdf):
        tok = load(vocabulary)
        pieces = [list(map(int, x)) for x in pdf.sort_values("__no")["__ids"]]
        return pdf[names].head(1).assign(__ids=[join_all(tok, pieces)])

    numbered = rows.where(is_long).select(*names, F.monotonically_increasing_id().alias("__row"), "__text")
    pieces = numbered.mapInPandas(cut, f"{keys}, __row long, __no int, __text string").repartition("__row", "__no")
    encoded = pieces.mapInArrow(whole, f"{keys}, __row long, __no int, __ids array<int>")
    joined = encoded.groupBy("__row").applyInPandas(grow, f"{keys}, __ids array<int>")
    return short.unionByName(joined).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("__ids").alias(out))
