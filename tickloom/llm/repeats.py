"""Removal of repeated byte strings by suffix arrays, with threshold-bounded interval expansion.

Each byte covered by a ``LENGTH``-byte string that also starts anywhere else, in any document, is
found. A suffix array over all documents is not built: every LENGTH-byte window has a minimiser,
the least hash of its ``GRAM``-byte substrings, which depends on its content alone, so equal
windows meet under equal minimisers. Runs of windows with one minimiser are segments.

1. Minimisers are counted by a grouped aggregate. Segments of a minimiser that stands once cannot
   repeat and go no further. Of the others, segments of equal content are repeated as a whole and
   are marked at once, each content goes on with one witness.
2. A window has half of what is beside its minimiser or more on one side of it, so different
   contents can share one only if they agree in the hash of the half on the left or on the right
   of the minimiser. Contents that agree with none are done; of the others the side that agrees
   with none is cut off.
3. The contents of a minimiser are brought into one task, many minimisers to a batch. The batch's
   suffix array and Burrows-Wheeler transform are built, and intervals are extended backwards
   breadth-first from the empty string: boundaries appear by increasing common prefix, and the
   expansion stops at LENGTH - 1. Neighbours without a boundary share LENGTH bytes or more.
4. A minimiser whose contents hold more than ``MOST_BYTES`` is not put into one task: its windows
   are hashed one by one and counted by a grouped aggregation, which is exact as well.
5. Marks are merged per document and joined to the texts.

Joins by a hot key have a plain exchange on both sides, so that adaptive execution can split it.
Tables that no later step reads are deleted.

Rows are keyed by a hash of id and text, so repeated ids with different texts are separate, and
identical rows count as two places.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; identical documents
of LENGTH bytes or more lose everything; an empty table gives no rows. Equality of strings is by
64-bit hashes in steps 1 and 4 and by bytes in step 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, aggregate, free_names, partitions_for
from .textops import chunks, column_bytes, mix, powers, prefix, span_hash, trimmed

LENGTH, GRAM, POSITION_BITS = 200, 24, 24
MOST_BYTES, BATCH_BYTES, PIECE = 6 << 20, 1 << 19, 1 << 20


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimiser, content hash, text number, start in text, bytes, several, left, left half, right half) of every segment.

    The least hash is looked for by its upper 40 bits, the leftmost on a tie; ``several`` tells that
    the minimiser stands at more than one place of the segment, which may then repeat itself. ``left``
    counts the bytes before the minimiser. The halves are hashes of the minimiser with ``side`` bytes
    before or after it, 0 where the segment has fewer: no window lacks both.
    """
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        u = z.astype(np.uint64)
        return u, u, z, z, z, z.astype(bool), z, u, u
    p = prefix(data)
    _, down = powers(n + 1)
    g = mix((p[gram:] - p[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    m = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    place = (m & low).astype(np.int64)
    value = g[place]
    at = np.arange(n - length + 1)
    doc = np.searchsorted(offs, at, side="right") - 1
    inside = offs[doc + 1] - at >= length
    turn = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(np.append(True, turn | ~inside[:-1]) & inside)
    e = np.flatnonzero(np.append(turn | ~inside[1:], True) & inside)
    a, end, side = place[s], e + length, half(length, gram)
    left = np.where(a - side >= s, span_hash(p, np.maximum(a - side, 0), a + gram), np.uint64(0))
    right = np.where(a + gram + side <= end, span_hash(p, a, np.minimum(a + gram + side, n)), np.uint64(0))
    return value[s], span_hash(p, s, end), doc[s], s - offs[doc[s]], end - s, a != place[e], a - s, left, right


def half(length: int, gram: int) -> int:
    """A window of ``length`` has as many bytes on one side of its minimiser at least."""
    return (length - gram + 1) // 2


def _small(n: int) -> type:
    """Places in n bytes are held in four bytes where they fit: the largest batch decides what a worker takes."""
    return np.int32 if n < 1 << 30 else np.int64


def suffix_order(symbols: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Rank of every suffix; each separator is a symbol of its own, below all bytes. The last symbol is one."""
    n = len(symbols)
    place = np.arange(n, dtype=_small(n))
    sep_at = np.flatnonzero(separator).astype(place.dtype)
    to_sep = np.repeat(sep_at, np.diff(sep_at, prepend=-1)) - place
    h = 7
    pack = np.zeros(n, np.int64)
    padded = np.append(symbols.astype(np.int16) + 1, np.zeros(h, np.int16))
    for k in range(h):
        pack <<= 9
        pack |= np.where(k < to_sep, padded[k : n + k], 0)
    tie = np.where(to_sep < h, place + to_sep, 0)
    del to_sep, padded
    order = np.argsort(pack, kind="stable").astype(place.dtype)  # of equal packs, those with a separator stand in its order already
    pack, tie = pack[order], tie[order]
    new = np.append(True, (pack[1:] != pack[:-1]) | (tie[1:] != tie[:-1]))
    del pack, tie
    rank = np.empty_like(place)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    del order, new
    while True:
        taken = np.zeros(n + 1, bool)
        taken[n] = taken[rank] = True
        open_ = np.flatnonzero(~taken[rank + 1]).astype(place.dtype)  # a rank is the place of the first of its equals
        if not len(open_):
            return rank
        r = rank[open_]
        key = r.astype(np.int64) * (n + 1)
        key += np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable").astype(place.dtype)
        key, r, at = key[o], r[o], place[: len(o)]
        group = np.append(True, r[1:] != r[:-1])
        equal = np.append(True, key[1:] != key[:-1])
        del key
        rank[open_[o]] = r + np.maximum.accumulate(np.where(equal, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        h *= 2


def repeated_starts(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each text, the starts of its strings of ``length`` bytes that start twice or more in the texts."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    symbols, separator = np.zeros(n, np.uint8), np.zeros(n, bool)
    separator[ends - 1] = True
    symbols[~separator] = np.concatenate(texts)
    rank = suffix_order(symbols, separator)
    place = np.arange(n, dtype=rank.dtype)
    sa, psi = np.empty_like(place), np.empty_like(place)
    sa[rank] = place
    lf = rank[sa - 1]
    del rank
    psi[lf] = place
    before = np.where(separator[sa - 1], 256 + sa - 1, symbols[sa - 1])[psi]  # the transform's symbols, sorted
    again = np.full_like(place, n)  # next place of the same symbol in the transform
    same = before[1:] == before[:-1]
    again[psi[:-1][same]] = psi[1:][same]
    del place, before, psi, same
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    head = np.where(separator[sa], 256 + sa, symbols[sa])
    fresh = (np.flatnonzero(head[1:] != head[:-1]) + 1).astype(sa.dtype)
    del head
    bound[fresh] = True
    for _ in range(1, length):
        if not len(fresh):
            break
        every = np.flatnonzero(bound).astype(sa.dtype)
        left = every[np.searchsorted(every, fresh) - 1]
        width = fresh - left
        total = np.cumsum(width, dtype=sa.dtype)  # n at most, as the intervals do not overlap
        q = np.arange(total[-1], dtype=sa.dtype) + np.repeat(left - (total - width), width)
        k = lf[q[again[q] >= np.repeat(fresh, width)]] + 1
        k = k[~bound[k]]
        bound[k] = True
        k.sort()
        fresh = k[np.append(True, k[1:] != k[:-1])] if len(k) else k
    k = np.flatnonzero(~bound)
    starts = np.unique(np.concatenate([sa[k - 1], sa[k]]))
    text = np.searchsorted(ends, starts, side="right")
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [starts[cut[t] : cut[t + 1]] - (ends[t] - sizes[t]) for t in range(len(texts))]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, bytes) of the merged windows."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(g[0]), int(g[-1] - g[0]) + length) for g in np.split(starts, cut)]


MARK = "rk long, start int, bytes int"


def _batch(rows: list[tuple], length: int) -> pa.RecordBatch:
    out = []
    for (rk, start, known), found in zip([r[:3] for r in rows], repeated_starts([r[3] for r in rows], length), strict=True):
        if not known:
            out += [(rk, start + a, b) for a, b in _runs(found, length)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32())], ["rk", "start", "bytes"])


def find_repeats(docs: DataFrame, stage: Stage, length: int = LENGTH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs: (rk, text). (rk, start, bytes): marked byte ranges; they may overlap."""
    spark, parts = docs.sparkSession, partitions_for(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            rks = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, d, o in chunks(data, offs, PIECE):
                step = 1 << (POSITION_BITS - 1)
                for at in range(0, len(d), step) if b == a + 1 else (0,):  # a very long text in overlapping parts
                    part = d[at : at + step + length - 1] if b == a + 1 else d
                    m, c, doc, start, size, several, left, hl, hr = segments(part, o if b > a + 1 else np.array([0, len(part)]), length)
                    halves = [pa.array(h.view(np.int64), mask=h == 0) for h in (hl, hr)]
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), pa.array(rks[a:b][doc]), pa.array((start + at).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(several), pa.array(left.astype(np.int32)), *halves], ["anchor", "content", "rk", "start", "bytes", "several", "left", "hl", "hr"])

    segs = stage.put(docs.mapInArrow(trimmed(cut), "anchor long, content long, rk long, start int, bytes int, several boolean, left int, hl long, hr long"), "segments")
    anchors = aggregate(segs, ["anchor"], F.count("*").alias("n"), (F.min("content") < F.max("content")).alias("mixed"), F.max("several").alias("bent"))
    open_ = stage.put(segs.join(anchors.where("n > 1 OR bent").drop("n"), "anchor"), "open")
    stage.drop("segments")
    # a content's first place is its witness; all columns of a row are the same row's
    first = [F.first(c).alias(c) for c in ("rk", "start", "bytes", "left", "hl", "hr", "mixed", "bent")]
    contents = stage.put(open_.groupBy("anchor", "content").agg((F.count("*") > 1).alias("dup"), *first), "contents")
    marked = stage.put(open_.join(contents.where("dup").select("anchor", "content"), ["anchor", "content"], "left_semi").select("rk", "start", "bytes"), "marked")
    stage.drop("open")

    tagged = {c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), "anchor", c)) for c in ("hl", "hr")}
    wide = contents.where("mixed OR bent").withColumns(tagged)
    sides = wide.where("NOT bent").select(F.explode(F.array("hl", "hr")).alias("h")).where("h IS NOT NULL").groupBy("h").count().where("count > 1").select("h")
    sides = stage.put(sides, "sides")
    for c in ("hl", "hr"):
        wide = wide.join(sides.select(F.col("h").alias(c), F.lit(True).alias(f"same_{c}")), c, "left")
    near = wide.where("bent OR same_hl OR same_hr")
    reach = half(length, GRAM) - 1  # bytes that a window has beyond the minimiser on a side that agrees with none
    cut_left = F.when(~F.col("bent") & F.col("same_hl").isNull(), F.greatest(F.lit(0), F.col("left") - reach)).otherwise(0)
    end = F.when(~F.col("bent") & F.col("same_hr").isNull(), F.least("bytes", F.col("left") + GRAM + reach)).otherwise(F.col("bytes"))
    near = near.select("anchor", "rk", (F.col("start") + cut_left).cast("int").alias("start"), (end - cut_left).cast("int").alias("bytes"), "dup")
    near = stage.put(near.where(F.col("bytes") >= length), "near")
    held = stage.put(near.groupBy("anchor").agg(F.sum(F.col("bytes").cast("long")).alias("held")).where(F.col("held") > most_bytes).select("anchor", F.lit(True).alias("hot")), "hot")
    places = aggregate(near.join(held, "anchor", "left"), ["rk"], F.collect_list(F.struct("anchor", "start", "bytes", "dup", "hot")).alias("places"))
    stage.drop("contents", "sides")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            rows = []
            for k, (rk, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                rows += [(x["anchor"], rk, x["start"], x["dup"], bool(x["hot"]), data[offs[k] + x["start"] : offs[k] + x["start"] + x["bytes"]].tobytes()) for x in places]
                if len(rows) > 4000:
                    yield _fetched(rows)
                    rows = []
            if rows:
                yield _fetched(rows)

    texts = docs.join(places, "rk").select("rk", "text", "places").mapInArrow(trimmed(fetch), "anchor long, rk long, start int, dup boolean, hot boolean, content binary")
    texts = stage.put(texts, "witnesses")
    stage.drop("near")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            data, offs = column_bytes(batch.column(4))
            for k, (anchor, rk, start, dup) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if size >= BATCH_BYTES and anchor != last:
                    yield _batch(held, length)
                    held, size = [], 0
                last = anchor
                held.append((rk, start, dup, data[offs[k] : offs[k + 1]].copy()))
                size += int(offs[k + 1] - offs[k])
        if held:
            yield _batch(held, length)

    cold = texts.where("NOT hot").select("anchor", "rk", "start", "dup", "content").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(expand), MARK)
    marks = stage.put(marked.unionByName(cold), "marks")
    if held.limit(1).count():
        marks = stage.put(marks.unionByName(_hot_windows(texts.where("hot"), stage, length)), "all-marks")
        stage.drop("marks", "windows")
    stage.drop("witnesses", "marked", "hot")
    return marks


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "rk", "start", "dup", "hot", "content"])


def _hot_windows(texts: DataFrame, stage: Stage, length: int) -> DataFrame:
    """Marks of the minimisers that are too large for one task: every window's hash, counted."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column(3))
            rks, starts, dups = (batch.column(c).to_pylist() for c in range(3))
            for k in range(batch.num_rows):
                d = data[offs[k] : offs[k + 1]]
                at = np.arange(len(d) - length + 1)
                h = span_hash(prefix(d), at, at + length)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, rks[k], np.int64)), pa.array((at + starts[k]).astype(np.int32)), pa.array(np.full(n, dups[k], bool))], ["h", "rk", "start", "dup"])

    w = stage.put(texts.select("rk", "start", "dup", "content").mapInArrow(trimmed(hashes), "h long, rk long, start int, dup boolean"), "windows")
    twice = aggregate(w, ["h"], F.count("*").alias("n")).where("n > 1").select("h")
    return w.where("NOT dup").join(twice, "h", "left_semi").select("rk", "start", F.lit(length).cast("int").alias("bytes"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with n_bytes long, spans array<struct<start, end>> (removed byte runs) and kept binary, in place of columns of those names."""
    stage = Stage(docs.sparkSession, "repeats")
    keep = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    rk, found, body, out = free_names(docs, "_rk", "_marks", "_t", "_o")
    keyed = docs.select(*keep, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in keep if dict(docs.dtypes)[c] in ("string", "bigint", "int")]).alias(rk))
    marks = find_repeats(keyed.select(F.col(rk).alias("rk"), F.coalesce(F.col(text), F.lit("")).alias("text")), stage, length, most_bytes)
    lists = aggregate(marks.withColumnRenamed("rk", rk), [rk], F.collect_set(F.struct("start", "bytes")).alias(found))
    joined = keyed.join(lists, rk, "left").withColumn(body, F.coalesce(F.col(text), F.lit("")))

    @F.pandas_udf("n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    def strip(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for t, m in zip(texts, marks, strict=True):
            b = t.encode()
            if m is None or not len(m):
                rows.append((len(b), [], b))
                continue
            pairs = sorted((x["start"], x["start"] + x["bytes"]) for x in m)
            spans = [list(pairs[0])]
            for a, e in pairs[1:]:
                if a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([a, e])
            kept = b"".join(b[a:e] for a, e in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(b)], strict=True))
            rows.append((len(b), [{"start": a, "end": e} for a, e in spans], kept))
        return pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])

    return joined.withColumn(out, strip(body, found)).select(*keep, f"{out}.n_bytes", f"{out}.spans", f"{out}.kept")
