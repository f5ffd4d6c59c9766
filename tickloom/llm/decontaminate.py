"""Benchmark decontamination by spaced-seed hashing. DataFrame and SQL functions only.

Texts are lower-cased and cut into tokens at white space and common punctuation; beyond ASCII all
punctuation counts, but for apostrophes and hyphens, and each character of a script without spaces
(Chinese, Japanese, Thai, Lao, Khmer, Burmese, Tibetan) is a token. A document is
contaminated by a benchmark item if ``WINDOW`` aligned tokens of both differ in at most
``MAX_SUBSTITUTIONS`` places. Seeds are fixed masks over token positions: a mask hashes the tokens
at its ones and ignores those at its zeros, so a hash survives substitutions under the zeros. The
two masks below hit every one of the 78 ways of placing two substitutions in 13 tokens (checked
exhaustively in the tests), so the seeds lose nothing that the verification would accept.

Test and training hashes are joined, then each hit's neighbourhood is verified: every window of
``WINDOW`` aligned tokens around the hit is compared token by token. Items shorter than a window
have to be matched as a whole, without substitution, by a mask of all their tokens. An item of a
single token is matched only by a document of that token alone, as a word in a text is no leak.

Training positions are first reduced inside the row: a position counts only if its first two
tokens are a pair that the benchmark has (all masks begin with two ones), then only if its mask
hash is in a second bit table. Both tables are in the plan and have ``BITS_EACH`` bits or more for
each value, up to ``MOST_BITS`` (128 KB), so what is shipped is bounded; beyond some
65,000 benchmark tokens they let more positions through and the join decides.

Defined cases: null and empty texts and items match nothing; repeated items are reported under each
id; repeated rows of documents give one row per id and item; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

WINDOW, MAX_SUBSTITUTIONS = 13, 2
#: each begins with two ones; together they hit any 13 tokens with up to two substitutions
MASKS = ("1101001011", "11010111")
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 20, 16
SEPARATORS = r"""[\x20\x09-\x0D.,;:!?"()\[\]]+"""
#: beyond ASCII: a character that is a token (group 1), or a separator; apostrophes and hyphens are neither, like those of ASCII
BEYOND_ASCII = r"([[^\x00-\x7F]&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\u30FC\uFF70]&&[^\p{P}]])|[[^\x00-\x7F\u2010\u2011\u2018\u2019]&&[\p{P}\p{Z}\u0085\u200B]]"


def token_hashes(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.when(F.octet_length(t) == F.char_length(t), t).otherwise(F.regexp_replace(t, BEYOND_ASCII, " $1 "))
    return F.transform(F.filter(F.split(t, SEPARATORS), lambda x: x != ""), lambda x: F.xxhash64(x))


def _ones(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seed(mask: str, h: str = "_h", i: str = "i") -> str:
    return f"xxhash64('{mask}', " + ", ".join(f"get({h}, {i} + {o})" for o in _ones(mask)) + ")"


def table_bits(values: int) -> int:
    """Bits of a table of so many values: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * values - 1).bit_length())) if values else LEAST_BITS


def _bit_table(values: DataFrame, bits: int) -> str:
    """SQL of a foldable array of longs: bit (v mod bits) is set for each value v. At most bits / 63 longs reach the driver."""
    rows = values.select(F.expr(f"pmod(v, {bits}L)").alias("b")).groupBy((F.col("b") / 63).cast("int").alias("k")).agg(F.expr("bit_or(shiftleft(1L, CAST(b % 63 AS int)))").alias("w")).collect()
    table = dict(map(tuple, rows))
    # one string, folded to an array when the plan is optimised: thousands of literals would swell every plan before that
    return "CAST(split('" + ",".join(str(table.get(k, 0)) for k in range(bits // 63 + 1)) + "', ',') AS array<bigint>)"


def _set_in(table: str, value: str, bits: int) -> str:
    at = f"pmod({value}, {bits}L)"
    return f"(shiftright(get({table}, CAST({at} div 63 AS int)), CAST({at} % 63 AS int)) & 1L) = 1L"


def find_leaks(docs: DataFrame, bench: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(*keys, item_id, first_token, last_token, windows, best): a row per document and item that leaks into it.

    first_token and last_token bound the matched tokens, ``windows`` counts the matching windows and
    ``best`` is the most tokens that agree in one.
    """
    stage = Stage(docs.sparkSession, "leaks")
    items = bench.select(F.col(item_id).alias("item_id"), token_hashes(F.col(item_text)).alias("_h")).where("size(_h) > 0")
    items = stage.put(items.withColumn("len", F.size("_h")), "items")
    short = sorted(r[0] for r in items.where(F.col("len") < WINDOW).select("len").distinct().collect())
    masks = [*MASKS, *("1" * n for n in short if n > 1)]
    alone = ["1"] if 1 in short else []  # matched by documents of one token

    def seeds(mask: str) -> DataFrame:
        fits = F.col("len") == len(mask) if "0" not in mask else F.col("len") >= WINDOW
        at = F.expr(f"transform(sequence(0, len - {len(mask)}), i -> struct(i AS pos, {_seed(mask)} AS seed))")
        return items.where(fits).select("item_id", "len", "_h", F.explode(at).alias("s")).select("item_id", "len", "_h", "s.pos", "s.seed", F.lit(len(mask)).alias("span"))

    test = seeds(masks[0])
    for m in masks[1:] + alone:
        test = test.unionByName(seeds(m))
    # the item's tokens around the seed, with -1 outside, so that both sides are aligned arrays
    around = "transform(sequence(-{w}, span + {w} - 1), k -> coalesce(IF({p} + k < 0, NULL, get(_h, {p} + k)), {none}))"
    test = stage.put(test.select("item_id", "len", "pos", "seed", "span", F.expr(around.format(w=WINDOW, p="pos", none="-1L")).alias("there")), "test")
    first_two = items.where("len > 1").select(F.explode(F.expr("transform(sequence(0, len - 2), i -> xxhash64(get(_h, i), get(_h, i + 1)))")).alias("v"))
    if not test.limit(1).count():
        first_two = first_two.where("false")
    tokens = items.agg(F.sum("len")).first()[0] or 0
    pair_bits, seed_bits = table_bits(tokens), table_bits(len(MASKS) * tokens)
    pairs, known = _bit_table(first_two, pair_bits), _bit_table(test.select(F.col("seed").alias("v")), seed_bits)

    d = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], token_hashes(F.col(text)).alias("_h"))
    least = min(map(len, masks))
    start = "IF(size(_h) < {n}, CAST(array() AS array<int>), sequence(0, size(_h) - {n}))"
    pair = _set_in(pairs, "xxhash64(get(_h, i), get(_h, i + 1))", pair_bits)
    # explode_outer: explode's own filter on the array's size would be pushed down, and the tokens evaluated for each position
    d = d.withColumn("_c", F.expr(f"filter({start.format(n=least)}, i -> {pair})"))
    ids = [f"_k{i}" for i in range(len(keys))]
    hit = [f"transform(filter(_c, i -> i <= size(_h) - {len(m)} AND {_set_in(known, _seed(m), seed_bits)}), i -> struct(i AS pos, {_seed(m)} AS seed, {len(m)} AS span))" for m in masks]
    hit += [f"transform(filter(IF(size(_h) = 1, array(0), CAST(array() AS array<int>)), i -> {_set_in(known, _seed(m), seed_bits)}), i -> struct(i AS pos, {_seed(m)} AS seed, 1 AS span))" for m in alone]
    d = d.withColumn("_s", F.expr(f"concat({', '.join(hit)})"))
    train = d.select(*ids, "_h", F.explode_outer("_s").alias("s")).where("s IS NOT NULL").select(*ids, F.col("s.pos").alias("at"), F.col("s.seed").alias("seed"), F.col("s.span").alias("span"), "_h")
    train = train.select(*ids, "at", "seed", "span", F.expr(around.format(w=WINDOW, p="at", none="-2L")).alias("here"))

    joined = train.join(test, ["seed", "span"])
    # windows of the alignment that begin within WINDOW tokens before the seed; a short item is one window
    n = f"IF(len < {WINDOW}, len, {WINDOW})"
    allowed = f"IF(len < {WINDOW}, 0, {MAX_SUBSTITUTIONS})"
    # a window lies inside the text and the item: places beyond either outweigh all others
    same = f"zip_with(here, there, (a, b) -> CASE WHEN a = -2L OR b = -1L THEN -{2 * WINDOW} WHEN a = b THEN 1 ELSE 0 END)"
    v = joined.select(*ids, "item_id", "at", F.expr(same).alias("same"), F.expr(n).alias("n"), F.expr(allowed).alias("sub"), F.expr(f"IF(len < {WINDOW}, array({WINDOW}), sequence(1, {WINDOW}))").alias("starts"))
    score = "aggregate(slice(same, f + 1, n), 0, (a, b) -> a + b)"
    v = v.withColumn("w", F.expr(f"filter(transform(starts, f -> struct(at - {WINDOW} + f AS p, {score} AS s)), x -> x.s >= n - sub)"))
    v = v.select(*ids, "item_id", "n", F.explode_outer("w").alias("w")).where("w IS NOT NULL")
    out = v.groupBy(*ids, "item_id").agg(F.min("w.p").alias("first_token"), F.max(F.col("w.p") + F.col("n") - 1).alias("last_token"), F.count_distinct("w.p").alias("windows"), F.max("w.s").alias("best"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "item_id", "first_token", "last_token", "windows", "best")
