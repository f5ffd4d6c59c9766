"""Token counts by offset-mapped attribution.

Every document is encoded once, as a whole. Its tokens' byte spans are the running sum of the
tokens' lengths; the spans are joined to the document's sections by binary search (an interval
join inside the row, linear in the document, so nothing is shuffled). A token that crosses section
boundaries is allocated by ``rule``:

* ``start``: to the section that holds its first byte;
* ``majority`` (default): to the section that holds most of its bytes, the earlier one on a tie;
* ``proportional``: to each section by its share of the token's bytes.

Sections are the lines of a text, each with its line end, so that they cover it without gaps. The
counts of the sections of a document add up to its tokens under every rule.

The vocabulary is a tiktoken rank file, read on the driver and broadcast (refused above
``MAX_VOCABULARY_BYTES``).

Defined cases: a null or empty text has no sections and no rows; repeated rows give repeated rows;
runs of any length of one kind of character are encoded like short ones; columns beside id and text
are not looked at; a null id is a null; an empty table gives no rows; offsets are given in characters and in bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import column_bytes

MAX_VOCABULARY_BYTES = 64 << 20
LONG_RUN = 10_000
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the pre-tokenisation pattern that belongs to the rank file
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, section int, char_start long, char_end long, byte_start long, byte_end long, tokens long, share double, crossing int"
_encoders: dict[int, tuple] = {}


def encoder(raw: bytes):
    """(encoding, byte length of each id); once per Python worker."""
    if hash(raw) not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _encoders[hash(raw)] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[hash(raw)]


#: fixed value: the White_Space characters of Unicode, a run of which the pattern cannot take in one piece
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)


def encode(enc, text: str) -> np.ndarray:
    """Ids of the tokens of a text.

    The pattern takes a run of white space less its last character, if a word follows, as one piece,
    but fails on runs of some 500,000 characters. Long runs are cut out beforehand at that very
    place and encoded as the piece that they are, so the tokens are the same.
    """
    parts, at = [], 0
    for m in BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        parts += [enc.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(enc._encode_single_piece(text[m.start() : end]), np.uint32)]
        at = end
    return np.concatenate([*parts, enc.encode_to_numpy(text[at:], disallowed_special=())])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, share, crossing) of each section from token ends and section bounds, both in bytes."""
    n = len(bounds) - 1
    starts = np.append(0, ends[:-1])
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    tokens = np.zeros(n, np.int64)
    share = np.zeros(n)
    crossing = np.zeros(n, np.int64)
    inside = first == last
    tokens += np.bincount(first[inside], minlength=n)
    for t in np.flatnonzero(~inside):
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[parts + 1], ends[t]) - np.maximum(bounds[parts], starts[t])
        crossing[parts] += 1
        if rule == "proportional":
            share[parts] += held / held.sum()
        tokens[parts[0] if rule == "start" else parts[held.argmax()]] += 1
    return tokens, share + (np.bincount(first[inside], minlength=n) if rule == "proportional" else tokens), crossing


def count_sections(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, rule: str = "majority", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per section: tokens (whole tokens by ``majority`` unless ``rule`` is start), share (under ``rule``), crossing tokens."""
    if rule not in ("start", "majority", "proportional"):
        raise ValueError(rule)
    with open(vocabulary, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoder(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            data, offs = column_bytes(texts)
            held, cols = 0, []
            for k in range(batch.num_rows):
                b = data[offs[k] : offs[k + 1]]
                if not len(b):
                    continue
                ends = np.cumsum(sizes[encode(enc, texts[k].as_py())])
                bounds = np.append(0, np.flatnonzero(b == 10) + 1)
                if bounds[-1] != len(b):
                    bounds = np.append(bounds, len(b))
                chars = np.append(0, np.cumsum((b & 0xC0) != 0x80))[bounds]
                n = len(bounds) - 1
                cols.append((np.full(n, k), np.arange(n), chars[:-1], chars[1:], bounds[:-1], bounds[1:], *attribute(ends, bounds, rule)))
                held += n
                if held >= 50_000:
                    yield _rows(ids, cols)
                    held, cols = 0, []
            if cols:
                yield _rows(ids, cols)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def _rows(ids: pa.Array, cols: list[tuple]) -> pa.RecordBatch:
    k, sec, c0, c1, b0, b1, tokens, share, crossing = (np.concatenate(x) for x in zip(*cols, strict=True))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(sec.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (c0, c1, b0, b1, tokens)), pa.array(share), pa.array(crossing.astype(np.int32))], ["doc_id", "section", "char_start", "char_end", "byte_start", "byte_end", "tokens", "share", "crossing"])
