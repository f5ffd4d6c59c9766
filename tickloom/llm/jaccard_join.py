"""N-gram Jaccard join by parity sketches.

A document's set is its distinct k-word shingles, hashed to 64 bits. Tokens are XORed into blocks,
so two sketches differ in at most as many blocks (and bits) as the sets' symmetric difference has
members. Sets of sizes a <= b with Jaccard similarity t or more differ in at most d = a (1 - t) / t
shingles; a sketch of more than d blocks therefore agrees in some block. Blocks that hold nothing
are left out where the others must agree too.

Size bands fix the number of blocks; a set goes to its own band and to the band below if a partner
may be there. Sets of more than ``SEGMENT`` shingles are split into segments by hash: some segment
differs in at most d / segments places, and the pigeonhole is applied inside it.

1. Equal sets are one class, found by a fingerprint; one text of each class goes on.
2. Block keys are counted by a grouped aggregate; (key, class) rows are joined to the keys that
   occur twice or more. A key occurs once at most for each class. This is done for ``SLICES`` slices
   of the keys in turn, as these rows are the most that is shuffled at a time.
3. Star: in each key's group every class is paired with the group's most connected class. Pairs are
   pruned by size and by the bit sketches of the segment (their Hamming distance is a lower bound),
   and only what is left is compared by its whole sets. Links are contracted to components. Groups
   of one component are done, so a group of copies of one text costs as many comparisons as it has
   members.
4. Rest: groups with several components are compared pairwise by size and bit sketches; what is near
   goes to families, whose members are compared exactly by blocked matrix products. Groups and
   families are split into tiles of bounded size, so that no task holds an unbounded group, and only
   a spanning forest of links leaves a tile.

The outcome is exact up to collisions of 64-bit hashes. Every step is a written table, deleted when
no later step reads it. Joins by a hot key have a plain exchange on both sides,
so that adaptive execution can split it.

Defined cases: null texts and texts without words have an empty set, size 0, and are linked with
nothing; a text of fewer than k words has its whole sequence as its one shingle; repeated rows are
copies; null ids are joined by their texts and never are a component's id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, aggregate, connected_components, partitions_for
from .textops import COEF, chunks, column_bytes, mix, shingle_sets, trimmed

SEGMENT, TILE, TILE_BYTES, SLOTS, SLICES = 512, 1024, 4 << 20, 4_000_000, 2
EMPTY = np.uint64(0x5851F42D4C957F2D)


class Layout:
    """Blocks of the bands for a threshold of ``percent``."""

    def __init__(self, percent: int):
        self.percent, self.bands = percent, []
        lo = 1
        while lo < 1 << 31:
            hi = lo * 3 // 2 + 1
            d = (hi - 1) * (100 - percent) // percent
            parts = -(-hi // SEGMENT)
            each = d // parts
            blocks = each + 1 + (each * 14 // 100 + 1 if percent < 85 else each >= 8)
            bits = min(2048, max(64, 1 << (4 * (hi // parts) - 1).bit_length()))
            self.bands.append((lo, hi, parts, each, blocks, bits))
            lo = hi
        self.lows = np.array([b[0] for b in self.bands])

    def of(self, n: int) -> range:
        """Bands of a set of n shingles."""
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        least = -(-n * self.percent // 100)
        return range(int(np.searchsorted(self.lows, max(1, least), side="right")) - 1, own + 1)

    def keys(self, u: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, which are used) for every block."""
        _, _, parts, each, blocks, _ = self.bands[band]
        m = parts * blocks
        at = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        at = at[first]
        value = np.full(m, EMPTY)
        full = np.zeros(m, bool)
        value[at] = np.bitwise_xor.reduceat(mix(u ^ COEF[60]), first)
        full[at] = True
        empties = (~full).reshape(parts, blocks).sum(1)
        used = full | np.repeat(empties >= blocks - each, blocks)
        return mix(value ^ _places(m, band)), used

    def sketch(self, u: np.ndarray, band: int) -> np.ndarray:
        """(segments, bits / 64) words of parity bits: the word by the shingle's place in the order of hashes, as blocks are, the bit by its low bits."""
        _, _, parts, _, _, bits = self.bands[band]
        words = bits // 64
        at = ((u >> np.uint64(32)) * np.uint64(parts * words)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out = np.zeros(parts * words, np.uint64)
        out[at[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (u & np.uint64(63)), first)
        return out.reshape(parts, words)


@functools.lru_cache(maxsize=64)
def _places(m: int, band: int) -> np.ndarray:
    return mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of a column of sketches, and the offset of each."""
    data, offs = column_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint64), offs // 8


def distances(words: np.ndarray, offs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distance of the sketches i[k] and j[k], which are of one length."""
    out, size = np.zeros(len(i), np.int64), offs[i + 1] - offs[i]
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for part in np.array_split(at, -(-len(at) * int(n) // (1 << 20)) or 1):
            step = np.arange(n)
            x, y = (words[offs[k[part]][:, None] + step] for k in (i, j))
            out[part] = np.bitwise_count(x ^ y).sum(1)
    return out


def class_id(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(u)) ^ np.bitwise_xor.reduce(mix(u ^ COEF[59])) * COEF[58] + np.uint64(len(u))]))[0].view(np.int64))


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offs = column_bytes(texts)
    for a, _, d, o in chunks(data, offs, 1 << 20):
        for j, u in shingle_sets(d, o, k):
            yield a + j, u


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns, over batch borders."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last:
                if held:
                    yield last, held
                last, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield last, held


def _heads(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Which rows begin a run of equal first ``keys`` columns."""
    head = np.zeros(batch.num_rows, bool)
    head[:1] = True
    for c in range(keys):
        v = batch.column(c).to_numpy()
        head[1:] |= v[1:] != v[:-1]
    return head


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end with a run of equal first ``keys`` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        last = int(np.flatnonzero(_heads(batch, keys))[-1])
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held


def _tiled(df: DataFrame, group: list[str], tiles: str) -> DataFrame:
    """Deals the rows of each group to pairs (ti, tj) of hashed tiles: any two rows meet in some pair."""
    t = df.withColumn("_n", F.expr(f"CAST({tiles} AS int)")).withColumn("own", F.expr("CAST(pmod(xxhash64(cid), _n) AS int)"))
    t = t.withColumn("_x", F.explode(F.expr("sequence(0, _n - 1)")))
    return t.withColumns({"ti": F.least("own", "_x"), "tj": F.greatest("own", "_x")}).drop("_n", "_x")


def _sized(percent: int) -> str:
    """SQL of the bound on sizes: sets of na and nb shingles may be linked."""
    return f"100L * least(na, nb) >= {percent}L * greatest(na, nb)"


def components(docs: DataFrame, stage: Stage, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: (id, text). ((id, n, cid) a row per row, (cid, comp) for the classes that have links).

    Tables that no later step reads are deleted as it goes; the two returned remain.
    """
    spark, parts = docs.sparkSession, partitions_for(docs.sparkSession)
    layout = Layout(percent)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for j, u in _sets(batch.column(1), k):
                n[j], cid[j] = len(u), class_id(u)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cid, mask=n == 0), batch.column(1)], ["id", "n", "cid", "text"])

    # 1. one text for each class
    classed = stage.put(docs.select("id", "text").mapInArrow(trimmed(classify), "id long, n int, cid long, text string"), "classed")
    light = stage.put(classed.select("id", "n", "cid"), "light")
    reps = stage.put(classed.where("cid IS NOT NULL").select("cid", "text").dropDuplicates(["cid"]), "reps")
    stage.drop("classed")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, rows, size = batch.column(0), [], 0
            for j, u in _sets(batch.column(1), k):
                for band in layout.of(len(u)):
                    keys, used = layout.keys(u, band)
                    rows.append((j, len(u), band, keys.view(np.int64), used, layout.sketch(u, band)))
                    size += len(keys)
                if size > 500_000:
                    yield _sketched(cids, rows)
                    rows, size = [], 0
            if rows:
                yield _sketched(cids, rows)

    # 2. (block key, class) rows: the keys that classes share are counted first, map-side combined
    sketched = stage.put(reps.mapInArrow(trimmed(sketch), "cid long, n int, band int, keys array<bigint>, bits array<binary>"), "sketches")
    per = F.element_at(F.array(*[F.lit(b[4]) for b in layout.bands]), F.col("band") + 1)
    rows = sketched.select("cid", "n", "band", F.posexplode("keys").alias("pos", "key")).where("key IS NOT NULL")
    slot = (F.col("band") * SLOTS + (F.col("pos") / per).cast("int")).cast("int")
    parts_of_g = []
    for k_slice in range(SLICES):  # slices of the keys, so that only one's rows are in a shuffle at a time
        own = rows.where(F.expr(f"pmod(key, {SLICES}L) = {k_slice}"))
        shared = stage.put(own.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), f"shared-{k_slice}")
        parts_of_g.append(stage.put(own.join(shared, "key").select("key", "cid", "n", slot.alias("slot"), "g"), f"groups-{k_slice}"))
        stage.drop(f"shared-{k_slice}")
    g = functools.reduce(DataFrame.unionByName, parts_of_g)
    bits = stage.put(sketched.select("cid", "band", F.posexplode("bits").alias("pos", "bits")).select("cid", (F.col("band") * SLOTS + F.col("pos")).alias("slot"), "bits").join(g.select("cid", "slot").distinct(), ["cid", "slot"], "left_semi"), "bits")
    stage.drop("sketches")

    # 3. star: pairs are pruned by size and sketch before any text is attached
    reach = aggregate(g, ["cid"], F.sum("g").alias("reach"))
    hub = aggregate(g.join(reach, "cid"), ["key"], F.max_by(F.struct(F.col("cid").alias("hub"), F.col("n").alias("nb")), F.struct("reach", "cid")).alias("h")).select("key", "h.*")
    star = g.withColumnRenamed("n", "na").join(hub, "key").where(f"hub <> cid AND {_sized(percent)}").select("hub", "cid", "slot").distinct()

    limits = np.array([b[3] for b in layout.bands])

    def near_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, offs), (y, _) = words_of(batch.column(3)), words_of(batch.column(4))
                far = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), offs[:-1])
                ok = pa.array(far <= limits[batch.column(2).to_numpy() // SLOTS])
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    both = star.join(bits.withColumnRenamed("bits", "x"), ["cid", "slot"]).join(bits.select(F.col("cid").alias("hub"), "slot", F.col("bits").alias("y")), ["hub", "slot"])
    near = stage.put(both.select("hub", "cid", "slot", "x", "y").mapInArrow(trimmed(near_hub), "a long, b long").distinct(), "star")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs = batch.column(0).to_numpy()
            first, at = np.unique(hubs, return_index=True)
            ones = {int(first[j]): u for j, u in _sets(batch.column(2).take(pa.array(at)), k)}
            cids = batch.column(1).to_pylist()
            yield _edges([(int(hubs[j]), cids[j]) for j, u in _sets(batch.column(3), k) if _linked(ones[int(hubs[j])], u, percent)])

    members = near.join(reps.withColumnsRenamed({"cid": "b", "text": "there"}), "b")
    pairs = members.join(reps.withColumnsRenamed({"cid": "a", "text": "here"}), "a").select("a", "b", "here", "there")
    links = stage.put(pairs.mapInArrow(trimmed(compare), "a long, b long"), "links")
    stage.drop("star")
    comp = stage.put(connected_components(stage, links, "first").select(F.col("id").alias("cid"), "comp"), "comp")

    # 4. rest: groups that still hold several components
    r = stage.put(g.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).select("key", "cid", "n", "slot", "comp"), "grouped")
    several = aggregate(r, ["key"], F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("g")).where("lo <> hi").select("key", "g")
    stage.drop(*(f"groups-{k_slice}" for k_slice in range(SLICES)))

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 3):
            ti, tj, cid, comp, own, n, slot = (batch.column(c).to_numpy() for c in range(1, 8))
            words, offs = words_of(batch.column(8))
            head = _heads(batch, 3)
            end = np.append(np.flatnonzero(head)[1:], len(head))[np.cumsum(head) - 1]
            each, forest = limits[slot // SLOTS], _Forest()
            left = np.arange(len(head))
            for d in range(1, int((end - left).max())):  # pairs of rows d apart in their group
                left = left[left + d < end[left]]
                i, j = left, left + d
                ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((ti[i] == tj[i]) | (own[i] != own[j]))
                i, j = i[ok], j[ok]
                ok = distances(words, offs, i, j) <= each[i]
                out = [(a, b) for a, b in zip(cid[i[ok]].tolist(), cid[j[ok]].tolist(), strict=True) if forest.join(a, b)]
                if out:
                    yield _edges(out)

    dealt = _tiled(r.join(several, "key").join(bits, ["cid", "slot"]), ["key"], f"greatest(1, ceil(g / {TILE}))")
    pairs = dealt.select("key", "ti", "tj", "cid", "comp", "own", F.col("n").cast("long").alias("n"), "slot", "bits").repartition(parts, "key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(trimmed(nearby), "a long, b long")
    pairs = stage.put(pairs.distinct(), "near")
    sizes = stage.put(r.select("cid", "n").distinct(), "sizes")
    stage.drop("grouped", "bits")
    if not pairs.limit(1).count():
        stage.drop("reps", "links", "near", "sizes")
        return light, comp
    family = connected_components(stage, pairs, "families").select(F.col("id").alias("cid"), F.col("comp").alias("family"))
    members = stage.put(family.join(sizes, "cid").join(comp, "cid", "left").select("family", "cid", "n", F.coalesce("comp", "cid").alias("comp")), "members")
    weight = aggregate(members, ["family"], F.sum(F.col("n").cast("long") * 8).alias("bytes"), F.count("*").alias("rows"))
    tiles = _tiled(members.join(weight, "family").join(reps, "cid"), ["family"], f"greatest(1, ceil(bytes / {TILE_BYTES}), ceil(rows / {TILE}))")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            sets = [u for _, u in _sets(pa.array([r[2] for r in rows]), k)]
            out = _exact_links([r[0] for r in rows], np.array([r[1] for r in rows]), sets, percent)
            if out:
                yield _edges(out)

    more = tiles.select("family", "ti", "tj", "cid", "comp", "text").repartition(parts, "family", "ti", "tj").sortWithinPartitions("family", "ti", "tj").mapInArrow(trimmed(exact), "a long, b long")
    all_links = stage.put(more.unionByName(comp.select(F.col("cid").alias("a"), F.col("comp").alias("b"))), "all-links")
    stage.drop("reps", "links", "near", "sizes", "members", "comp")
    out = stage.put(connected_components(stage, all_links, "last").select(F.col("id").alias("cid"), "comp"), "components")
    stage.drop("all-links")
    return light, out


def _exact_links(ids: list[int], comps: np.ndarray, sets: list[np.ndarray], percent: int, width: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components: intersections by matrix products over slices of the vocabulary."""
    m = len(ids)
    n = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(m), n)
    vocabulary, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    doc, col = doc[shared], np.searchsorted(np.flatnonzero(count > 1), col[shared])
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    inter = np.zeros((m, m), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [a, a + width])
        part = np.zeros((m, width), np.float32)
        part[doc[lo:hi], col[lo:hi] - a] = 1
        inter += part @ part.T
    union = n[:, None] + n[None, :] - inter
    i, j = np.nonzero(np.triu(100 * inter.astype(np.float64) >= percent * union, 1) & (comps[:, None] != comps[None, :]))
    forest = _Forest()
    return [(ids[a], ids[b]) for a, b in zip(i, j, strict=True) if forest.join(ids[a], ids[b])]


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)), values)


def _sketched(cids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    j, n, band, keys, used, bits = zip(*rows, strict=True)
    blocks = _lists(keys, pa.array(np.concatenate(keys), mask=~np.concatenate(used)))
    sketches = _lists(bits, pa.array([row.tobytes() for m in bits for row in m], pa.binary()))
    return pa.RecordBatch.from_arrays([cids.take(pa.array(j)), pa.array(n, pa.int32()), pa.array(band, pa.int32()), blocks, sketches], ["cid", "n", "band", "keys", "bits"])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs; component_id is the least id that links reach."""
    stage = Stage(docs.sparkSession, "jaccard")
    light, comp = components(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), stage, k, percent)
    # the least id of each class, then of each component, before the rows are joined to it
    low = aggregate(light.where("cid IS NOT NULL"), ["cid"], F.min("id").alias("low"))
    own = stage.put(low.join(comp, "cid", "left").select("cid", "low", F.coalesce("comp", "cid").alias("comp")), "own")
    named = stage.put(own.join(aggregate(own, ["comp"], F.min("low").alias("least")), "comp").select("cid", "least"), "named")
    stage.drop("own")
    return light.join(named, "cid", "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
