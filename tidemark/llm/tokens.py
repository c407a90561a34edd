"""Token ids of whole texts, cut into pieces of bounded length.

The vocabulary is named by a parameter and read from the installed public tokenizer files by each worker.
Texts of common Latin characters go through the faster of the two libraries that implement the same
vocabulary (its ids are equal there, which the tests hold); every other text goes through `tokenizers`.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa

from .staging import cut

VOCABULARY = "byte_bpe_50k"
END = 2
LENGTH = 1024
COMMON = re.compile(r"[\t\n\r -~¡-¬®-ɏ]*\Z")


def encoder(vocabulary: str = VOCABULARY):
    """A function from a text to its ids. Special tokens' strings count as ordinary text."""
    import base64

    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public.path(f"{vocabulary}.json"))
    exact.encode_special_tokens = True
    with open(public.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return fast.encode_ordinary(text) if COMMON.match(text) else exact.encode(text, add_special_tokens=False).ids

    return encode


def cuts(n: int, length: int) -> list[int]:
    """Offsets at which a document of n ids is cut: only the first piece may be short."""
    return [0, *range(n % length or length, n, length)]


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int | None = END, length: int = LENGTH, ids: bool = False):
    """A mapInArrow function: one row a piece, with its ids as unsigned 16-bit integers if asked for."""
    schema = PIECE.append(pa.field("ids", pa.binary())) if ids else PIECE

    def run(batches):
        encode = encoder(vocabulary)
        for batch in cut(batches, text):
            rows = {f.name: [] for f in schema}
            for doc, value in zip(batch.column(batch.schema.get_field_index(id_column)).to_pylist(), batch.column(batch.schema.get_field_index(text)).to_pylist()):
                got = np.array([*encode(value or ""), *([] if end is None else [end])], "<u4")
                begins = cuts(len(got), length)
                for k, (lo, hi) in enumerate(zip(begins, [*begins[1:], len(got)])):
                    part = got[lo:hi]
                    rows["doc_id"].append(doc)
                    rows["piece"].append(k)
                    rows["start"].append(lo)
                    rows["length"].append(len(part))
                    rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if ids:
                        if part.max(initial=0) > 0xFFFF:
                            raise ValueError(f"ids of {vocabulary} don't fit 16 bits")
                        rows["ids"].append(part.astype("<u2").tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run
