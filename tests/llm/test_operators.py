"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, jaccard_join, language_id, mixing, quality_model, quality_rules, queries, repeats, token_counts, url_filter, warc
from tickloom.llm.common import Stage, connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, LONG, "en", "a"), (5, LONG, "en", "b"), (5, LONG, "en", "b"), (None, "some words here", None, None), (6, "one two", "de", "b"), (7, "one two", "de", "b"), (8, "!!! 123", "fr", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    # extra columns with names that operators use themselves
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("x") for c in ("score", "size", "spans", "_row", "kept", "n_words", "u", "host", "comp")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(200)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def brute_components(pairs, k, percent):
    sets, up = [], {}
    for i, (_, t) in enumerate(pairs):
        w = WORD.findall(lower(t))
        sets.append(set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()))
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        seen = Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        least[find(i)].append(d)
    low = {c: min((d for d in ds if d is not None), default=None) for c, ds in least.items()}
    return sorted(((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(pairs)), key=repr)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, docs, k, percent):
    rng = random.Random(k)
    vocabulary = [f"v{i}" for i in range(400)]
    made, n = texts(docs), 10_000
    for size in (12, 40, 150, 900):  # families at all distances from the threshold
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, max(2, size // 20))):
                t[rng.randrange(size)] = rng.choice(vocabulary)
            made.append((n, " ".join(t)))
            n += 1
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df, k, percent).collect()), key=repr)
    assert got == brute_components(made, k, percent)


def test_jaccard_tiles_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 6000)
    rng = random.Random(9)
    base = [f"v{rng.randrange(300)}" for _ in range(200)]
    made = []
    for n in range(40):
        t = list(base)
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(200)] = f"z{rng.randrange(10_000)}"
        made.append((n, " ".join(t)))
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"), 3, 90).collect()), key=repr)
    assert got == brute_components(made, 3, 90)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(4)
    layout = jaccard_join.Layout(90)
    for n in (40, 300, 1500):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 12], rng.integers(0, 2**63, n // 12, dtype=np.uint64)]))
        band = layout.of(n)[0]
        x, y = layout.sketch(a, band), layout.sketch(b, band)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_jaccard_edges(spark, edge, empty):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(edge, 3, 90).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), *[(d, len(set(zip(*[LONG.split()[j:] for j in range(3)]))), 4) for d in (4, 5, 5)], (None, 1, None), (6, 1, 6), (7, 1, 6), (8, 1, 8)], key=repr)
    assert jaccard_join.jaccard_components(empty, 3, 90).count() == 0


def test_components_of_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, connected_components(Stage(spark, "t"), e, "c").collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def brute_repeats(pairs, length):
    count = Counter(b[i : i + length] for _, b in pairs for i in range(len(b) - length + 1))
    out = []
    for d, b in pairs:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, m in zip(b, cover, strict=True) if not m)).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()), key=repr)


@pytest.mark.parametrize("most", [repeats.MOST_BYTES, 500])
def test_repeats_equal_brute_force(spark, docs, most):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(420))
    made = texts(docs)[:60] + [(900 + k, f"{rng.random()} " * 15 + passage[rng.randint(0, 150) :] + f" {rng.random()}" * 9) for k in range(12)] + [(990, "ab" * 400), (991, "x" * 260), (992, "x" * 199)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert digest(repeats.remove_repeats(df, most_bytes=most)) == brute_repeats([(d, t.encode()) for d, t in made], 200)


def test_interval_expansion_equals_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.choice([4, 8, 30])
        base = bytes(rng.choice(b"abc") for _ in range(80))
        made = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 40)
            made.append(np.frombuffer(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) + base[a : a + rng.randint(0, 40)], np.uint8))
        count = Counter(bytes(t[i : i + n]) for t in made for i in range(len(t) - n + 1))
        assert [list(g) for g in repeats.repeated_starts(made, n)] == [[i for i in range(len(t) - n + 1) if count[bytes(t[i : i + n])] > 1] for t in made]


def test_repeats_batch_memory():
    """a batch of a minimiser's near copies takes less than 80 bytes of memory for each of its bytes, and finds the same starts."""
    rng = np.random.default_rng(4)
    base = rng.integers(97, 123, 350).astype(np.uint8)
    made = [base.copy() for _ in range(1500)]
    for t in made:
        t[rng.integers(0, 350, 3)] = rng.integers(97, 123, 3)
    repeats.repeated_starts(made[:2], 200)
    tracemalloc.start()
    got = repeats.repeated_starts(made, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    count = Counter(bytes(t[i : i + 200]) for t in made for i in range(151))
    assert [list(g) for g in got] == [[i for i in range(151) if count[bytes(t[i : i + 200])] > 1] for t in made]
    assert peak < 80 * sum(len(t) for t in made), peak


def test_repeats_edges(spark, edge, empty):
    got = digest(repeats.remove_repeats(edge))
    assert got == brute_repeats([(d, (t or "").encode()) for d, t, *_ in EDGE], 200)
    assert repeats.remove_repeats(empty).count() == 0


def test_masks_hit_every_pair_of_substitutions():
    n = decontaminate.WINDOW
    for bad in itertools.combinations(range(n), decontaminate.MAX_SUBSTITUTIONS):
        assert any(all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(n - len(m) + 1))


def brute_leaks(docs, bench):
    cut = lambda t: [w for w in re.split(decontaminate.SEPARATORS, (t or "").lower()) if w]
    items, out = [(i, cut(t)) for i, t in bench], set()
    grams = lambda w, k: set(zip(*[w[j:] for j in range(k)], strict=False))
    for d, t in docs:
        w = cut(t)
        for i, b in items:
            # 13 tokens with two substitutions keep a run of four, shorter items are matched whole
            if not grams(b, min(4, max(1, len(b)))) & grams(w, min(4, max(1, len(b)))):
                continue
            n, sub = min(len(b), decontaminate.WINDOW), decontaminate.MAX_SUBSTITUTIONS if len(b) >= decontaminate.WINDOW else 0
            if n > 1 and any(sum(x == y for x, y in zip(w[p : p + n], b[q : q + n], strict=False)) >= n - sub for p in range(len(w) - n + 1) for q in range(len(b) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    v = [f"w{i}" for i in range(60)]
    bench = [(k, " ".join(rng.choice(v) for _ in range(n))) for k, n in enumerate((30, 18, 13, 12, 5, 1, 0))] + [(7, None), (8, "Hello, (big) World. again!")]
    made = []
    for k in range(60):
        b = bench[k % 5][1].split()
        a = rng.randint(0, max(0, len(b) - 13))
        part = b[a : a + rng.randint(4, 20)]
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "changed"
        made.append((k, " ".join(rng.choice(v) for _ in range(rng.randint(0, 30))) + " " + ", ".join(part) + " end"))
    made += [(100, "say hello big world AGAIN now"), (101, None), (102, "")]
    df, items = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, items, ["doc_id"]).collect()}
    assert got == brute_leaks(made, bench)


def test_leaks_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "some words here"), (2, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(edge, items, ["doc_id"]).collect()} == {(None, 1)}
    assert decontaminate.find_leaks(empty, items, ["doc_id"]).count() == 0
    assert decontaminate.find_leaks(edge, items.where("false"), ["doc_id"]).count() == 0


def test_leaks_in_scripts_without_spaces(spark):
    zh, th = "今天天气很好我们一起去公园散步吧", "ภาษาไทยเขียนติดกันโดยไม่เว้นวรรค"
    items = spark.createDataFrame([(1, zh), (2, th), (3, "Hello"), (4, "eins zwei drei vier"), (5, "東京")], "item_id long, text string")
    made = [(1, f"前文。{zh}！后文"), (2, th), (3, zh[:6] + "雨" + zh[7:]), (4, zh[:5]), (5, "hello!"), (6, "hello world"), (7, "x «eins zwei\u00a0drei… vier»"), (8, "私は東京へ"), (9, "東"), (10, "we’re x-y"), (11, f"abc{th}def")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(made, "doc_id long, text string"), items, ["doc_id"]).collect()}
    assert got == {(1, 1), (2, 2), (3, 1), (5, 3), (7, 4), (8, 5), (11, 2)}


def test_rules_equal_brute_force(spark, docs, edge, empty):
    want = []
    pairs = texts(docs)[:120] + [(d, t or "") for d, t, *_ in EDGE] + [(50, "a b c a b c a b c x"), (51, "line\nline\n\nline \n| # $")]
    for d, t in pairs:
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = set()
        for i in range(len(w) - 2):
            if tri[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)))
    df = quality_rules.with_figures(spark.createDataFrame(pairs, "doc_id long, text string"))
    got = [tuple(r) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert quality_rules.judge(edge).count() == len(EDGE) and quality_rules.judge(empty).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    rows = [(i, "bad " * 3 if i % 10 else " ".join(f"w{j}" for j in range(80)), "en", "bad") for i in range(100)] + [(1000 + i, " ".join(f"w{j + i}" for j in range(80)), "en", f"h{i % 5}") for i in range(100)] + [(5000, "x", "en", "tiny")]
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[0].base_failed and not out[0].kept
    assert all(out[1000 + i].kept for i in range(100))


def test_mixing_meets_targets(spark, docs, edge, empty):
    out = mixing.mix(docs, [5, 2, 1])
    rows = out.collect()
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        b = by[source[r.doc_id]]
        b[0], b[1], b[2], b[3] = b[0] + r.taken, r.source_size, r.target, max(b[3], r.size)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(b[1] for b in by.values())
    assert sum(b[2] for b in by.values()) == pytest.approx(total)
    for taken, size, target, largest in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= largest
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), [5, 2, 1]).collect())) == sorted(map(tuple, rows))
    assert mixing.mix(edge, [5, 2, 1]).count() == len(EDGE) and mixing.mix(empty, [5, 2, 1]).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_url_rules(spark):
    urls = {None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "http://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"), "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"), "http://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"), "http://x.com": ("x.com", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://org?x": ("org", "", None, "allow")}
    df = spark.createDataFrame([(u, "x") for u in urls], "url string, verdict string")
    for most in (url_filter.MAX_TRIE_BYTES, 0):  # the trie, and the join for large rule sets
        got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, "url", RULES, max_trie_bytes=most).collect()}
        assert got == urls
    assert url_filter.judge_urls(df.where("false"), "url", RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, "url", [], "block").collect()} == {"block"}


def test_url_join_equals_the_trie(spark):
    rules = [("", "/any", "block"), ("", "", "allow"), ("com", "/any/ok", "allow"), ("org", "", "block"), ("a.org", "/any", "allow")]
    urls = [None, "no scheme", "http:///any/x", "http://x.com/any", "http://x.com/any/ok/1", "http://x.com/other", "http://b.org/any", "http://a.org/any", "http://net/any", "http://net./any", "http://a..org/any", "http://single"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1)
    by_trie, by_join = ({r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, "url", rules, "none", max_trie_bytes=most).collect()} for most in (url_filter.MAX_TRIE_BYTES, 0))
    assert by_join == by_trie and by_join["http://net/any"][2:] == ("/any", "block")


def test_url_join_takes_every_path_length(spark):
    lengths, host = range(1, 10_101), "w.deep.net"
    path = F.concat(F.lit("/"), F.repeat(F.lit("x"), (F.col("id") - 1).cast("int")))
    rules = spark.range(1, lengths.stop, 1, 2).select(F.lit("deep.net").alias("host"), path.alias("path"), F.lit("block").alias("verdict"))
    df = spark.range(1, lengths.stop, 1, 1).where("id IN (1, 2, 501, 9999, 10000, 10001, 10050, 10100)").select("id", F.lit(host).alias("host"), path.alias("path"))
    got = {r.id: (len(r.rule), r.verdict) for r in url_filter._judge_by_join(df, rules, "allow").collect()}
    assert got == {n: (len("deep.net") + n, "block") for n in (1, 2, 501, 9999, 10000, 10001, 10050, 10100)}


def test_archives_round_trip(spark):
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9
    rows = [(3, "x" * 120), (1, "x" * 120), (2, "y" * 99), (4, "y" * 99), (5, None), (6, ""), (7, tricky), (8, tricky), (9, "é" * 60), (10, "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    index, root = warc.archive(df)
    back = warc.read_records(index, root)
    got = {r.page_id: r for r in back.collect()}
    body = {k: (h or "").encode() for k, h in rows}
    for k, b in body.items():
        twins = [j for j, c in body.items() if c == b] if len(b) >= 100 else [k]
        assert got[k].payload_bytes == len(b) and got[k].payload_digest == hashlib.sha256(b).hexdigest()
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if k == min(twins) else ("revisit", min(twins)))
        assert got[k].payload is None if k != min(twins) else got[k].payload == b
    import gzip

    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(root + "/records")
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(base))]
    assert any(f.endswith(".cdx") for f in files)
    whole = b"".join(gzip.decompress(fs.open_input_file(f).read()) for f in files if f.endswith(".warc.gz"))
    assert whole.count(b"WARC-Record-ID") == len(rows)
    index, root = warc.archive(df.where("false"))
    assert warc.read_records(index, root).count() == 0


def test_archives_of_odd_rows(spark, monkeypatch):
    x = "x" * 120
    rows = [(1, x), (1, x), (None, x), (2, x), (2, x), (None, "y" * 150), (None, "y" * 150), (3, "short"), (3, "short"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("q") for c in ("key", "digest", "size", "refers_to", "k")})
    for copies in (warc.COPIES, 2):  # repeated rows in one block, and in several
        monkeypatch.setattr(warc, "COPIES", copies)
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(*warc.archive(df.repartition(3))).collect())
        assert got == Counter({(1, 120, "response", None): 1, (1, 120, "revisit", 1): 1, (None, 120, "revisit", 1): 1, (2, 120, "revisit", 1): 2, (None, 150, "response", None): 1, (None, 150, "revisit", None): 1, (3, 5, "response", None): 2, (4, 0, "response", None): 2}), copies
    assert warc.file_system("file:///tmp/a")[1] == "/tmp/a"


def test_columns_of_the_operators_own_names_stay(spark):
    names = ("_j", "_p", "_t", "_o", "_rk", "_marks", "_q_w", "_q_h", "_row")
    df = spark.createDataFrame([(1, "http://a.com/x", "one two"), (2, None, None)], "doc_id long, url string, text string").withColumns({n: F.lit(n) for n in names}).withColumn("n_words", F.lit("old"))
    rules = [("com", "/x", "block"), ("", "", "allow")]
    model = language_id.Model(["a"], np.zeros((language_id.DIM, 1), np.float32), np.zeros(1))
    for out in (url_filter.judge_urls(df, "url", rules), url_filter.judge_urls(df, "url", rules, max_trie_bytes=0), language_id.predict(df, model), repeats.remove_repeats(df), quality_rules.with_figures(df)):
        assert len(set(out.columns)) == len(out.columns)
        assert all(r[n] == n for r in out.collect() for n in names)
    assert [r.n_words for r in quality_rules.with_figures(df).orderBy("doc_id").collect()] == [2, 0]


def test_hosts_beyond_ascii(spark):
    df = spark.createDataFrame([(1, "http://MÜNCHEN.de/a"), (2, "http://münchen.DE/a")], "id long, url string")
    for size in (url_filter.MAX_TRIE_BYTES, 0):
        got = {r.id: r.verdict for r in url_filter.judge_urls(df, "url", [("mÜnchen.DE", "/a", "block")], max_trie_bytes=size).collect()}
        assert got == {1: "block", 2: "allow"}


def test_tokens_add_up_and_match_offsets(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = token_counts.DEFAULT_VOCABULARY
    tok = tokenizers.Tokenizer.from_file(path.replace(".tiktoken", ".json"))
    tok.encode_special_tokens = True
    rows = [(1, "Hello world\nsecond line é\n\n\n  tail"), (2, None), (3, ""), (4, "no end"), (5, "\n"), (6, LONG), (7, "a  \n  b\n")]
    got = defaultdict(list)
    for rule in ("start", "majority", "proportional"):
        for r in token_counts.count_sections(spark.createDataFrame(rows, "doc_id long, text string"), rule=rule).collect():
            got[rule, r.doc_id].append(r)
    for d, t in rows:
        spans = [s for s in tok.encode(t or "", add_special_tokens=False).offsets]
        for rule in ("start", "majority", "proportional"):
            sections = sorted(got[rule, d], key=lambda r: r.section)
            assert sum(r.share for r in sections) == pytest.approx(len(spans))
            assert sum(r.tokens for r in sections) == len(spans)
            if rule == "start" and t and t.isascii():
                assert [r.tokens for r in sections] == [sum(r.char_start <= a < r.char_end for a, _ in spans) for r in sections]
    with pytest.raises(ValueError):
        token_counts.count_sections(spark.createDataFrame(rows, "doc_id long, text string"), rule="other")


def brute_sections(lengths, text, rule):
    """(tokens, crossing) of each line: every token's bytes are looked up one by one."""
    data, line, at = text.encode(), [], 0
    for b in data:
        line.append(at)
        at += b == 10
    tokens, crossing, pos = Counter(), Counter(), 0
    for n in lengths:
        held = Counter(line[pos : pos + n])
        pos += n
        tokens[min(held) if rule == "start" else min(held, key=lambda s: (-held[s], s))] += 1
        if len(held) > 1:
            crossing.update(held.keys())
    return [(tokens[s], crossing[s]) for s in range((max(line) + 1) if line else 0)]


def test_tokens_of_sections_equal_brute_force(spark):
    enc, sizes = token_counts.encoder(open(token_counts.DEFAULT_VOCABULARY, "rb").read())
    rng = random.Random(5)
    pieces = ["word", " ", "  ", "\n", "\n\n", " \n \n", "\t\n", "é", "漢字", "12", "!", "\r\n", "    \n"]
    made = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    for rule in ("start", "majority"):
        got = defaultdict(list)
        for r in token_counts.count_sections(spark.createDataFrame(made, "doc_id long, text string"), rule=rule).collect():
            got[r.doc_id].append((r.section, r.tokens, r.crossing))
        for i, t in made:
            want = brute_sections(sizes[enc.encode_to_numpy(t, disallowed_special=())].tolist(), t, rule)
            assert [(tok, c) for _, tok, c in sorted(got[i])] == want, (t, rule)
    ends, bounds = np.array([4, 10]), np.array([0, 2, 4, 7, 10])  # ties, and a token over three lines
    assert token_counts.attribute(np.array([4, 10]), np.array([0, 2, 5, 7, 10]), "majority")[0].tolist() == [1, 0, 0, 1]
    assert token_counts.attribute(ends, bounds, "majority")[0].tolist() == [1, 0, 1, 0]


def test_tokens_of_long_runs(spark, monkeypatch):
    enc, sizes = token_counts.encoder(open(token_counts.DEFAULT_VOCABULARY, "rb").read())
    rows = [(1, "a" + " " * 1_000_000 + "b\n"), (2, "\n" * 600_000), (3, "x" * 1_000_000), (4, " \u3000" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("section", "tokens", "share")})
    out = token_counts.count_sections(df).groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.max("byte_end").alias("bytes")).collect()
    assert {r.doc_id: r.bytes for r in out} == {i: len(t.encode()) for i, t in rows} and all(r.n > 0 for r in out)
    monkeypatch.setattr(token_counts, "BLANKS", re.compile(token_counts.BLANKS.pattern.replace(str(token_counts.LONG_RUN), "3")))
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["ab", " ", "\n", "\t", "12", "!", "é'll"]) * rng.choice([1, 2, 5, 30]) for _ in range(rng.randrange(1, 12)))
        assert token_counts.encode(enc, t).tolist() == enc.encode_to_numpy(t, disallowed_special=()).tolist()


def test_language_is_learned(spark, edge, empty):
    out = queries.op2_language_id(spark, SF)
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [(r.lang_pred, true[r.doc_id]) for r in out.where("held_out").collect()]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    model = language_id.fit(edge.where("lang IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {(r.doc_id, r.lang_pred == "und") for r in language_id.predict(edge, model).collect()}
    assert {(1, True), (2, True), (3, True), (8, True), (4, False)} <= got
    assert language_id.fit(empty.select(F.col("doc_id").alias("id"), "text", "lang")) is None
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}


def test_ftrl_weights_are_sparse():
    rows = [(np.array([k % 2, 5, language_id.DIM]), np.array([1.0, 0.5, 1.0]), k % 2) for k in range(200)]
    w, _ = language_id.ftrl(rows, 2, 0.5, 1.0, 0.01, 0.01, 2, 0)
    assert w[0, 0] > 0 > w[0, 1] and np.count_nonzero(w) <= 6


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 600)
    z = rng.normal(0, 1, (600, 3)) + 1.5 * np.eye(3)[y]
    for stretch in (0.2, 1.0, 6.0):  # logits too flat, right and too steep
        loss = lambda t, z=z * stretch: -np.log(language_id.softmax(z / t)[np.arange(600), y]).mean()
        assert loss(language_id._temperature(z * stretch, y)) <= min(loss(t) for t in np.exp(np.linspace(np.log(0.06), np.log(19), 300))) + 1e-6


def test_ftrl_equals_its_formula():
    """One coordinate at a time, step by step, against the update as published."""
    rng, alpha, beta, l1, l2 = np.random.default_rng(0), 0.5, 1.0, 0.05, 0.1
    rows = [(np.append(rng.choice(6, 3, replace=False), language_id.DIM), np.append(rng.normal(size=3), 1.0), int(rng.integers(3))) for _ in range(60)]
    got, bias = language_id.ftrl(rows, 3, alpha, beta, l1, l2, 2, 4)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((beta + n[k] ** 0.5) / alpha + l2)

    order = np.random.default_rng(4)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            i, x, y = rows[r]
            logits = [sum(weight((int(a), c)) * v for a, v in zip(i, x, strict=True)) for c in range(3)]
            p = np.exp(logits) / np.exp(logits).sum()
            held = {(int(a), c): weight((int(a), c)) for a in i for c in range(3)}
            for a, v in zip(i, x, strict=True):
                for c in range(3):
                    k, g = (int(a), c), v * (p[c] - (c == y))
                    z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * held[k]
                    n[k] += g * g
    assert np.allclose(got[:6], [[weight((a, c)) for c in range(3)] for a in range(6)]) and np.allclose(bias, [weight((language_id.DIM, c)) for c in range(3)])


def test_pu_slopes_are_the_derivatives_of_the_risk():
    rng = np.random.default_rng(2)
    for shift, prior in ((0.0, 0.3), (3.0, 0.9)):  # the second has a negative estimate of the negatives' risk
        zp, zu = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 9)
        sig = lambda z: 1 / (1 + np.exp(-z))

        def objective(zp, zu, prior=prior, sig=sig):
            plus, minus = quality_model.pu_risk(sig(zp), sig(zu), prior)
            return plus + minus if base >= 0 else -minus

        base = quality_model.pu_risk(sig(zp), sig(zu), prior)[1]
        a_p, a_u = quality_model.pu_slopes(prior)(sig(zp), sig(zu))
        step = lambda n, k: 1e-6 * np.eye(n)[k]
        assert np.allclose(a_p, [(objective(zp + step(7, k), zu) - objective(zp - step(7, k), zu)) / 2e-6 for k in range(7)], atol=1e-5)
        assert np.allclose(a_u, [(objective(zp, zu + step(9, k)) - objective(zp, zu - step(9, k))) / 2e-6 for k in range(9)], atol=1e-5)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_class_prior_is_found_without_negatives(share):
    rng = np.random.default_rng(int(100 * share))
    good = lambda n: rng.normal(1.2, 1, (n, 6))
    unl = np.concatenate([good(int(3000 * share)), rng.normal(-1.2, 1, (3000 - int(3000 * share), 6))])
    assert abs(quality_model.class_prior(good(3000), rng.permutation(unl), 20, 0.005, 1e-3, 256, 1) - share) < 0.06


def test_quality_looks_at_no_negative_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    train = docs.join(spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "id", "left")
    a, b = quality_model.fit(train, epochs=4), quality_model.fit(train.withColumn("label", F.when(F.col("label") == 1, 1)), epochs=4)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_quality_is_learned(spark, edge, empty):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_quality_classifier(spark, sf)
    held = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([[a > b for b in bad] for a in good])
    assert auc >= 0.9, auc
    model = quality_model.fit(edge.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("label")))
    assert all(0 <= r.score <= 1 for r in quality_model.score(edge, model).collect())
    nothing = quality_model.fit(empty.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("int").alias("label")))
    assert {round(r.score, 6) for r in quality_model.score(edge, nothing).collect()} == {0.85}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("copies < 1 OR copies > 3").count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = {c for _, _, c in brute_components(texts(docs), 5, 80)}
    assert {r.doc_id for r in kept.collect()} == want
    leaks = brute_leaks(texts(docs), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()} == {d for d, _ in texts(docs)} - {d for d, _ in leaks}


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in EDGE]
    schema = SCHEMA + ", n_chars long"
    for made in (rows, []):
        df = spark.createDataFrame(made, schema)
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            df.count()


def brute_cut(rows, length=200):
    """Rows (doc_id, text, lang, source, n_chars) without their repeated bytes."""
    count = Counter(b[i : i + length] for b in ((r[1] or "").encode() for r in rows) for i in range(len(b) - length + 1))
    out = []
    for d, t, lang, source, n in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        if not any(cover):
            out.append((d, t, lang, source, n))
        elif not all(cover):
            kept = bytes(x for x, m in zip(b, cover, strict=True) if not m).decode("utf-8", "ignore")
            out.append((d, kept, lang, source, len(kept)))
    return out


def test_cut_repeats_equals_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(6)
    passage = "".join(rng.choice("abcdé ") for _ in range(420))
    # cuts that split é and ü, which share their first byte, and texts with U+FFFD of their own
    texts_ = [None, "", "short", "s" * 199, "t" * 200, "u" * 201, passage, passage, "é" + "q" * 250 + "é", "ü" + "q" * 250 + "ü", "\ufffd \x01 \x011 kept " + passage[5:] + " \ufffd", "\ufffd alone \x010", *[f"{rng.random()} é" * 9 + passage[rng.randint(0, 150) :] + f" {rng.random()}" for _ in range(9)]]
    part = "é" * 150
    texts_ += ["ä" + part, "Ã" + part + "x", part[1:] + "ö", "y" + part]
    rows = [(k, t, "en", "a", None if t is None else len(t)) for k, t in enumerate(texts_)]
    got = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA + ", n_chars long"), SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_cut(rows))


def test_pipeline_rows_equal_brute_force(spark, monkeypatch):
    import corpus_pipeline
    import duckdb
    import pandas as pd

    models, fit = [], quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select(*corpus_pipeline.COLUMNS, "size", "copies", "taken").collect())
    (model,) = models

    def scored(text):
        b = np.frombuffer((text or "").encode(), np.uint8)
        return float(model.scores(quality_model.features(b, np.array([0, len(b)])))[0])

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    kept = [r for r in rows if scored(r[1]) >= corpus_pipeline.THRESHOLD]
    assert 0 < len(kept) < len(rows)
    first = {c for _, _, c in brute_components([(r[0], r[1] or "") for r in kept], 5, 80)}
    kept = brute_cut([r for r in kept if r[0] in first])
    leaks = brute_leaks([r[:2] for r in kept], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    kept = [r for r in kept if r[0] not in {d for d, _ in leaks}]
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in kept], columns=["doc_id", "text", "source"])
    db = duckdb.connect()
    db.register("documents", documents)
    mixed = {r[0]: (r[1], r[4]) for r in db.execute(queries.OP8_SQL).fetchall()}
    assert all(size for size, _ in mixed.values())
    assert got == sorted((*r, size, taken // size, taken) for r in kept for size, taken in [mixed[r[0]]] if taken)
