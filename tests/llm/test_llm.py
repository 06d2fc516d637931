"""Operators against brute force on small tables with nulls, empty, long and repeated texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, exact_dedup, jaccard_join, language_id, nearest, packing, token_counts, token_files, tokens, toxicity, url_filter

WORDS = "the and ing tion idiot scum le la ere er un de von und das ist".split()
SCHEMA = "doc_id long, text string, lang string, id long, n int, key string, toxic int"


def _texts():
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    odd = ["", None, "   \n", "a", "A b c d", "a B c d", "x" * 5000, "don't  <|endoftext|> ½ 中文\r\n\t!!", "a b c d e f", "a b c d e f g", " ".join(["same"] * 3000)]
    return base + near + odd + base[:5] + [t.upper() for t in base[5:8]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else "de", 7, 8, "k", 0) for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(_texts()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(spark, docs, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(_lower(t), []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact_dedup.membership(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.dedup(docs).collect()} == {max(g) for g in groups.values()}


def test_exact_dedup_of_hot_groups(spark, docs, texts, monkeypatch):
    want = {tuple(r) for r in exact_dedup.membership(docs).collect()}
    monkeypatch.setattr(exact_dedup, "HOT", 60)
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 1)
    assert {tuple(r) for r in exact_dedup.membership(docs).collect()} == want and any(r[2] > len(texts) // 60 for r in want)
    rows = spark.createDataFrame([(None, "x"), (None, "X"), (3, "y"), (3, "y"), (4, None), (None, None)], "doc_id long, text string")
    got = sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.membership(rows).collect())
    assert got == [("3", "3", 2, True), ("3", "3", 2, True), ("4", "4", 2, True), ("None", "4", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_of_repeated_ids(spark, monkeypatch, clash):
    if clash:  # every text has the same digest
        monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.lit("x"))
    rows = [(5, "A"), (5, "B"), (9, "A"), (5, "b"), (None, "n"), (None, "n"), (None, "A"), (7, None), (7, "")]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = exact_dedup.dedup(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((str(r.doc_id), (r.text or "").lower()) for r in got) == [("5", "b"), ("7", ""), ("9", "a"), ("None", "n")]


def _components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[a] != low[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {(i, len(s), low[i]) for i, s in sets.items()}


def test_jaccard_join(spark, docs, texts):
    assert {(r.id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()} == _components(texts)


@pytest.mark.parametrize("boundary", [0, 4, 9])
def test_jaccard_boundary(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda info: boundary)
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "IN_ONE_TASK", 3)  # long lists are dealt over several tasks
    rng = random.Random(boundary)
    texts = {}
    for i in range(120):
        if i % 3 and texts:
            w = texts[rng.choice(list(texts))].split()
            w.insert(rng.choice((0, len(w))), f"n{i}") if rng.random() < 0.5 else w.pop(rng.choice((0, -1)))
        else:
            w = [f"w{rng.randrange(9)}" for _ in range(rng.randint(3, 18))]
        texts[i] = " ".join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {(r.id, r.n_shingles, r.component_id) for r in jaccard_join.join(frame).collect()} == _components(texts)


def test_subset_sizes_cover_links():
    for b in range(1, jaccard_join.largest_small() + 1):
        for n in range(1, b + 1):
            for m in range(1, b + 1):
                if 5 * min(n, m) >= 4 * max(n, m):
                    assert jaccard_join.pair_overlap(n, m) in jaccard_join.subset_sizes(n, b)


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(60)] + [(100 + i, " ".join(base[:100] + [f"u{i}x{k}" for k in range(100)])) for i in range(20)]
    got = {r.id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[100 + i] == 100 + i for i in range(20))


def test_prefixes_of_linked_sets_share_enough():
    rng = random.Random(8)
    links = 0
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(90), n))
        b = set(rng.sample(sorted(a), rng.randint(max(1, n - 8), n))) | set(rng.sample(range(90, 200), rng.randint(0, 4)))
        if 5 * len(a & b) >= 4 * len(a | b):
            links += 1
            order = rng.sample(range(200), 200)
            x, y = (set(sorted(s, key=order.__getitem__)[: jaccard_join.prefix_length(len(s))]) for s in (a, b))
            assert len(x & y) >= jaccard_join.least_shared(len(a), len(b)) >= 1
    assert links > 500


def test_chunks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # lists of 60 and 5 over 4 tasks: chunks are whole wherever tasks begin
        rows = spark.createDataFrame([(k, c % 7, 10, c, 3) for k, size in ((1, 60), (2, 5)) for c in range(size)], "key long, comp long, n int, c long, held long").repartition(3)
        got = jaccard_join._chunked(rows).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for key, size in ((1, 60), (2, 5)):
        mine = sorted((r.comp, r.n, r.c, r.chunk) for r in got if r.key == key)
        assert [r[3] for r in mine] == [k // 8 for k in range(size)]


def test_blocks_are_scanned_again_only_for_more(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    scan, needs = jaccard_join._long_pairs, []
    monkeypatch.setattr(jaccard_join, "_long_pairs", lambda rows, need, *rest: (needs.append(need.count()), scan(rows, need, *rest))[1])
    base = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(base[:30] + [f"u{i}x{k}" for k in range(30)]) for i in range(20)}
    got = {(r.id, r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _components(texts) and len(needs) <= 1  # nothing more to propose: no second scan


def test_pairs_sharing_few_rare_shingles_move_no_bitmaps(spark, monkeypatch):
    near, moved = jaccard_join._near, []
    monkeypatch.setattr(jaccard_join, "_near", lambda pairs, nodes: (moved.append(pairs.distinct().count()), near(pairs, nodes))[1])
    texts = {i: " ".join([f"w{k}" for k in range(30)] + [f"u{i}x{k}" for k in range(90)]) for i in range(3)}
    got = {(r.id, r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _components(texts) and moved[0] == 0


def test_forests_of_pairs():
    rng = random.Random(4)

    def joined(edges, u, v):
        seen, new = {u}, [u]
        while new:
            at = new.pop()
            new += [w for e in edges if at in e for w in e if w not in seen and not seen.add(w)]
        return v in seen

    for _ in range(60):
        size, most = rng.randint(2, 12), rng.randint(1, 5)
        edges = [tuple(rng.sample(range(100, 100 + size), 2)) for _ in range(rng.randint(0, 40))]
        x, y = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        took, tree = jaccard_join.forests(x, y, most)
        for k, (u, v) in enumerate(edges):
            for f in range(min(took[k], most)):  # those before it joined its ends by better edges
                assert joined([e for e, t in zip(edges[:k], took[:k], strict=True) if t == f], u, v)
            if took[k] < most:  # without it, its forest has no way
                assert not joined([e for j, (e, t) in enumerate(zip(edges, took, strict=True)) if t == took[k] and j != k], u, v)
        last = [e for e, t in zip(edges, took, strict=True) if t == most - 1]
        for k, (u, _) in enumerate(edges):
            if took[k] >= most - 1:
                assert all((tree[j] == tree[k]) == joined(last, u, edges[j][0]) for j in range(len(edges)) if took[j] >= most - 1)


@pytest.mark.parametrize("block", [16, 1024])
def test_proposals_grow_with_sets_not_with_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    near, scan, counts = jaccard_join._near, jaccard_join._long_pairs, []
    monkeypatch.setattr(jaccard_join, "_near", lambda pairs, nodes: near(pairs, nodes).limit(0))  # as if no pivot linked

    def counted(rows, need, *rest):
        out = scan(rows, need, *rest)
        counts.append((out.count(), need.count() * 2 * 2 * min(block, 60)))  # two forests over the sets of two blocks
        return out

    monkeypatch.setattr(jaccard_join, "_long_pairs", counted)
    base = [f"w{k}" for k in range(200)]
    texts = {i: " ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(60)} | {100 + i: " ".join(base[:100] + [f"u{i}x{k}" for k in range(100)]) for i in range(20)}
    got = {(r.id, r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _components(texts) and counts and all(made <= most for made, most in counts)


def test_lists_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    chunked, plans = jaccard_join._chunked, []
    monkeypatch.setattr(jaccard_join, "_chunked", lambda rows: (plans.append(rows._jdf.queryExecution().toString()), chunked(rows))[1])
    base = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(base[:30] + [f"u{i}x{k}" for k in range(30)]) for i in range(9)}
    assert {r.component_id for r in jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()} == set(texts)
    assert len(plans) == 1 and "Join" not in plans[0]  # dealing by range runs what is above it twice


def test_bpe(spark, docs, texts, library):
    for r in bpe.round_trip(docs, tokens.default_tokenizer()).collect():
        ids = library.encode(texts[r.id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(docs, tokens.default_tokenizer())
    assert {(r.id, r.text) for r in bpe.decode(encoded, tokens.default_tokenizer()).collect()} == {(i, t or "") for i, t in texts.items()}


@pytest.mark.parametrize("engine", ["library", "prefix"])
@pytest.mark.parametrize("tiny", [False, True])
def test_encoder_fuzz(library, engine, tiny, monkeypatch):
    if tiny:  # texts are cut, groups hold few texts, the table overflows
        for name, value in (("GROUP", 8), ("PART", 12), ("TABLE_BITS", 5), ("ENTRIES", 16), ("LONG_ENTRIES", 2)):
            monkeypatch.setattr(tokens, name, value)
    enc, rng = tokens.Encoder(tokens.default_tokenizer(), engine), random.Random(1)
    parts = list("ab tT'sle\n\t éß½²中😀_.,!\r\x01\x1c\u2003\xa0\u0301") + ["<|endoftext|>", "<|endof", "text|>", " the", "ing", "'s", "'re", "'ll", "'ve", "  ", ".\n", "\n\n", "longerthanfifteenbytes"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", "x" * 100, "中" * 50, "'", "'l", "'r"]
    for text, got in zip(texts, enc.batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_parts(library, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 50)
    monkeypatch.setattr(tokens, "PART", 100)
    texts = ["one two " * 100, "", "three", None, "four five six " * 60]
    enc, rows, got = tokens.Encoder(tokens.default_tokenizer()), [], []
    import pyarrow as pa

    for first, after, ids, ends in enc.column(pa.array(texts)):
        assert len(ends) == after - first
        rows.append((first, after))
        got += ids.tolist()
    assert len(rows) > 10 and got == [i for t in texts for i in library.encode(t or "", add_special_tokens=False).ids]


def test_token_files(spark, docs, texts, library, tmp_path):
    token_files.write(docs, tokens.default_tokenizer(), f"file://{tmp_path}/t")
    at = 0
    for r in token_files.digests(spark, f"file://{tmp_path}/t").orderBy("id").collect():
        ids = np.array([*library.encode(texts[r.id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.id for r in token_files.read(spark, f"file://{tmp_path}/t").collect()} == set(texts)


@pytest.mark.parametrize("high", [1, 2, 300, 50000, 1 << 40, 1 << 64])
def test_simple8b(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 239, 240, 241, 40000):
        v = rng.integers(0, high - 1, n, dtype=np.uint64, endpoint=True)
        v[50 : 50 + n // 3] = 0
        keys, ends, got = token_files.decode_block(token_files.encode_block([3, None], [v[: n // 2], v[n // 2 :]]))
        assert keys == [3, None] and ends.tolist() == [n // 2, n] and (got == v).all()


def test_packing(spark, docs, texts, library):
    rows = packing.pack(docs, tokens.default_tokenizer(), limit=64).collect()
    of, seq = {}, {}
    for r in rows:
        of.setdefault(r.id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert set(of) == set(texts)
    for i, ps in of.items():
        ids, at = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(100):
        limit = int(rng.integers(4, 150))
        pos = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, min(limit, 30) + 1, int(rng.integers(1, 40))))]))
        pen = rng.choice([0.0, 2.0, 24.0], len(pos))
        best = [0.0] + [1e18] * (len(pos) - 1)
        cost = lambda d: 0 if d & (d - 1) == 0 else limit - d
        for j in range(1, len(pos)):
            best[j] = min(best[i] + cost(int(pos[j] - pos[i])) + pen[j] + packing.PER_SEQUENCE for i in range(j) if pos[j] - pos[i] <= limit)
        total, a = 0, 0
        for j in packing.choose_cuts(pos, pen, limit):
            total, a = total + cost(int(pos[j] - pos[a])) + pen[j] + packing.PER_SEQUENCE, j
        assert a == len(pos) - 1 and abs(total - best[-1]) < 1e-6


def test_token_counts(spark, docs, texts, library):
    n = np.array([len(library.encode(t or "", add_special_tokens=False).ids) for t in texts.values()])
    h = token_counts.histogram(token_counts.lengths(docs, tokens.default_tokenizer()))
    for r in h.collect():
        assert (r.docs, r.docs_ge, r.ids_ge, r.truncated_ids, r.whole_ids) == ((n == r.length).sum(), (n >= r.length).sum(), n[n >= r.length].sum(), np.minimum(n, r.length).sum(), n[n <= r.length].sum())
    limits = [0, 1, 10, int(np.median(n)), int(n.max()), 10**6]
    assert {r.context_limit: r.total for r in token_counts.truncated_total(h, limits).collect()} == {x: np.minimum(n, x).sum() for x in limits}
    want = {x: int(np.sort(n)[max(0, int(np.ceil(x * len(n))) - 1)]) for x in (0.01, 0.5, 0.9, 1.0)}
    assert {r.share: r.length for r in token_counts.quantile(h, list(want)).collect()} == want
    none = h.where("false")
    assert [r.total for r in token_counts.truncated_total(none, [5]).collect()] == [0] and [r.length for r in token_counts.quantile(none, [0.5]).collect()] == [None]


def test_language(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("the and ing", "une être leaux")[i % 2].split()) for _ in range(40)), ("en", "fr")[i % 2]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(d)
    assert all(r.lang_pred == rows[r.id][2] and 0 <= r.score <= 1 for r in language_id.predict(d, net).collect())
    odd = {r.id: r.lang_pred for r in language_id.predict(spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "é" * 3000)], "doc_id long, text string"), net).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[4] == "fr"
    assert language_id.keep(d, net).count() == 200


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, " ".join([rng.choice(WORDS[:4] + WORDS[6:]) for _ in range(60)] + (["idiot", "scum"] if i % 4 == 0 else []))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    assert all(r.predicted == int(r.id % 4 == 0) for r in toxicity.score(d, model).collect())
    assert toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).count() == 2
    assert toxicity.keep(d, model).count() == 300


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 12), (1200, [float("nan")] * 12), (1300, [1.0])]
    found = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(d[r.vec_id] - r.score) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
    assert hits >= 54 and len(found) == 60


def test_scan_abandons_candidates_and_finds_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    index = nearest.Index(x, 4)
    rotated, ids, hits, read = np.ascontiguousarray((x @ index.rotation).astype(np.float32).T), np.arange(4000), 0, 0
    for q in range(40):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.argsort(d, kind="stable")[:10]
        got, near, values = nearest.scan(index, rotated, x, ids, x[q], q, 10, np.sort(d)[30])
        assert np.allclose(near, d[got]) and (np.diff(near) >= 0).all()
        hits, read = hits + len(set(got) & set(want)), read + values
    assert hits >= 390 and read < 0.6 * 40 * x.size


def test_nearest_finds_k_where_there_are_k(spark):
    x = np.random.default_rng(2).normal(size=(700, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = nearest.search(df, lambda i: i % 50 == 0, k=12, probes=1).collect()  # a list holds 11 on average
    assert sorted((r.query_id, r.rank) for r in found) == [(q, k) for q in range(0, 700, 50) for k in range(1, 13)]


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/x?q"), (2, "https://www.example.com/en/1"), (3, "http://b.net/es/2"), (4, "http://b.net/en/2#t"), (5, None), (6, "no scheme"), (7, "http://c.com"), (8, "http://notexample.com/en/"), (9, "http://h.org/" + "/".join("abcdefghijklmn") + "?x")]
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][:3] == ("b.net", "/en/2", None) and got[5] == got[6] == ("", "", None, "allow") and got[7] == ("c.com", "", None, "allow") and got[8][2] == "com/" and len(got) == 9
    labelled = [(i, f"http://z.org/bad/{w}") for i, w in enumerate(["p", "q"] * 10)]
    rules = (("z.org/bad/p", "block"),)
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(labelled, "page_id long, url string"), rules).where("rule IS NULL").collect()} == {"allow"}


def test_url_labels_reach_unlabelled_branches(spark):
    at = lambda host, *kinds: [f"http://{host}/{k}/{i}" for k in kinds for i in range(10)]
    urls = at("b.org", "p", "q", "r") + at("g.org", "p", "q", "r") + at("m.org", "p", "q", "r") + at("none.org", "r")
    rules = (("b.org/p", "block"), ("b.org/q", "block"), ("g.org/p", "allow"), ("g.org/q", "allow"), ("m.org/p", "allow"), ("m.org/q", "block"))
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(rows) == len(urls)
    assert {(r.host, r.verdict) for r in rows if r.rule is None} == {("b.org", "block"), ("g.org", "allow"), ("m.org", "allow"), ("none.org", "allow")}
    assert {r.template for r in rows if r.host == "b.org"} == {"/{p}/*"} and len({r.template for r in rows if r.host == "m.org"}) == 3


def _tree(rows):
    """(host, raw) to (template, share) by loops over dictionaries."""
    from collections import defaultdict
    from math import log

    def apart(h, n, H, N):
        if not n:
            return 0
        p, term = H / N, lambda a, b: a * log(a / b) if a else 0.0
        return 0 if 2 * (term(h, n * p) + term(n - h, n * (1 - p))) <= url_filter.CRITICAL else 1 if h / n > p else -1

    def pooled(of, key, *fields):
        out = defaultdict(lambda: [0] * len(fields))
        for r in of:
            for k, f in enumerate(fields):
                out[key(r)][k] += r[f]
        return out

    count = defaultdict(lambda: [0, 0, 0])
    for host, raw, label in rows:
        c = count[host, raw]
        c[0], c[1], c[2] = c[0] + 1, c[1] + (label is not None), c[2] + (label or 0)
    now = {k: k[1] for k in count}
    for level in range(max(len(k[1]) for k in count)):
        each = {}
        for k, t in now.items():
            if len(t) > level:
                e = each.setdefault((k[0], t[:level], t[level]), dict(up=(k[0], t[:level], t[level].startswith("*")), n=0, known=0, good=0, leaves=0))
                for f, v in zip(("n", "known", "good"), count[k]):
                    e[f] += v
                e["leaves"] += count[k][0] * (len(t) == level + 1)
        all_ = list(each.values())
        pool, many = pooled(all_, lambda r: r["up"], "leaves", "n"), defaultdict(int)
        for r in all_:
            many[r["up"]] += 1
        for r in all_:
            r["dl"] = apart(r["leaves"], r["n"], *pool[r["up"]])
            r["many"] = not r["up"][2] and many[r["up"]] >= url_filter.MANY and pool[r["up"]][1] < url_filter.ROWS_EACH * many[r["up"]]
        pool = pooled(all_, lambda r: (r["up"], r["dl"]), "good", "known")
        for r in all_:
            r["dg"] = apart(r["good"], r["known"], *pool[r["up"], r["dl"]]) if r["known"] else 9
        cell = lambda r: (r["up"], r["dl"], r["dg"])
        pool = pooled(all_, cell, "leaves", "n", "good", "known")
        for r in all_:
            L, N, G, K = pool[cell(r)]
            r["alike"] = not r["up"][2] and apart(r["leaves"], r["n"], L, N) == 0 and apart(r["good"], r["known"], G, K) == 0
        agree = defaultdict(list)
        for r in all_:
            if r["alike"] and r["dg"] != 9:
                agree[r["up"], r["dl"]].append(r["dg"])
        for r in all_:
            if r["dg"] == 9:
                got = agree[r["up"], r["dl"]]
                r["dg"] = got[0] if len(got) > 1 and len(set(got)) == 1 else None
        names = defaultdict(list)
        for k, r in each.items():
            if r["alike"] and not r["many"] and r["dg"] is not None:
                names[cell(r)].append(k[2])
        to = {k: "*" if r["many"] else "{" + min(names[cell(r)]) + "}" if r["alike"] and len(names[cell(r)]) > 1 and k[2] in names[cell(r)] else k[2] for k, r in each.items()}
        now = {k: t[:level] + (to[k[0], t[:level], t[level]],) + t[level + 1 :] if len(t) > level else t for k, t in now.items()}

    def share(keep, above):
        own = [count[k] for k in now if keep(k)]
        return (sum(c[2] for c in own) + url_filter.PRIOR * above) / (sum(c[1] for c in own) + url_filter.PRIOR)

    top = share(lambda k: True, url_filter.PRIOR_SHARE)
    out = {}
    for (host, raw), t in now.items():
        s = share(lambda k: k[0] == host, top)
        s = share(lambda k: k[0] == host and now[k][:1] == t[:1], s)
        own = lambda k: k[0] == host and now[k] == t
        out[host, raw] = ("/" + "/".join(t), share(own, s) if any(count[k][1] for k in now if own(k)) else url_filter.PRIOR_SHARE)
    return out


def test_url_tree_by_hand(spark):
    rng, rows = random.Random(9), []
    bad = {"casino", "pills", "win"}
    for _ in range(1500):
        host = rng.choice(("a.org", "b.org", "b.org", "c.org"))
        raw = tuple(rng.choice((["casino", "pills", "news", "blog", "wiki", "*"], ["x", "y", "*"], [f"slug-{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}", "*"])[d]) for d in range(rng.choice((1, 2, 3, 3))))
        label = None if rng.random() < 0.5 or raw[0] in ("win", "blog") else int(raw[0] not in bad)
        rows.append((host, raw, label))
    want = _tree(rows)
    got = url_filter.templates(spark.createDataFrame([(h, list(r), x) for h, r, x in rows], "host string, raw array<string>, label int")).collect()
    assert {(r.host, tuple(r.raw)): r.template for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.share - want[r.host, tuple(r.raw)][1]) < 1e-9 for r in got)
    assert min(r.share for r in got) < url_filter.LEAST_SHARE < max(r.share for r in got)


def test_urls_odd(spark):
    long = "http://l.org/" + "a/" * 300 + "b" * 20000
    rows = [(1, long, 7), (1, long, 7), (None, "http://l.org/x", 7), (2, "http://l.org", 8), (2, None, 8)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host long")).collect()
    assert len(got) == 5 and sorted(str(r.id) for r in got) == ["1", "1", "2", "2", "None"] and {r.verdict for r in got} == {"allow"}


def test_deep_paths_have_templates_of_their_own(spark):
    deep = "http://h.org/" + "/".join("abcdefgh")
    urls = [f"{deep}/{k}/x/{i}" for k in ("p", "q", "r", "s") for i in range(10)] + ["http://z.org/" + "/".join("abcdefghijklmnopqrstuvwxyz" * 4)]
    rules = ((deep[7:] + "/p", "block"), (deep[7:] + "/q", "block"), (deep[7:] + "/s", "allow"))
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r.template for r in rows} == {f"/a/b/c/d/e/f/g/h/{k}/x/*" for k in ("{p}", "r", "s")} | {"/" + "/".join("abcdefghijklmnopqrstuvwxyz" * 4)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, page_id long, url string, vec_id long, embedding array<double>, toxic int")
    path = tokens.default_tokenizer()
    for df in (exact_dedup.membership(none), exact_dedup.dedup(none), jaccard_join.join(none), bpe.round_trip(none, path), packing.pack(none, path), token_counts.histogram(token_counts.lengths(none, path)), language_id.predict(none, language_id.fit(none)), toxicity.score(none, toxicity.fit(none, none)), nearest.search(none, lambda i: i % 100 == 0), url_filter.judge(none)):
        assert df.count() == 0


def test_odd_rows(spark):
    """Null and repeated ids, ids of other types, clashing names."""
    rows = [(None, "the one two three four five", 1), (3, "the one two three four five", 2), (3, "other words stand here now at last", 3), (3, None, 4), (None, None, 5)]
    path = tokens.default_tokenizer()
    d = spark.createDataFrame(rows, "doc_id short, text string, id int").withColumn("ids", F.lit("x")).withColumn("key", F.lit(1))
    assert sorted((str(r.id), r.n_tokens) for r in bpe.round_trip(d, path).collect()) == [("3", 0), ("3", 6), ("3", 7), ("None", 0), ("None", 6)]
    assert sorted(str(r.id) for r in bpe.encode(d, path).collect()) == ["3", "3", "3", "None", "None"]
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>"), path).where("text = ''").count() == 2
    packed = packing.pack(d.coalesce(1), path).collect()
    assert {(str(r.id), r.doc_tokens) for r in packed} == {("3", 1), ("3", 7), ("3", 8), ("None", 1), ("None", 7)} and sum(r.length for r in packed) == 24
    assert token_counts.lengths(d, path).count() == 5
    got = sorted((str(r.id), r.n_shingles, str(r.class_id), str(r.component_id)) for r in jaccard_join.join(d).collect())
    assert got == [("3", 0, "3", "3"), ("3", 2, "3", "3"), ("3", 3, "3", "3"), ("None", 0, "None", "None"), ("None", 2, "3", "3")]
    assert jaccard_join.dedup(d).columns == d.columns and exact_dedup.dedup(d).columns == d.columns and exact_dedup.dedup(d).count() == 3
    train = spark.createDataFrame([(i, f"{w} " * 9, w) for i, w in enumerate(["the", "der", "les"] * 30)], "doc_id long, text string, lang string")
    net = language_id.fit(train)
    assert language_id.predict(d, net).count() == 5 and language_id.keep(d, net).columns == d.columns
    model = toxicity.fit(train, spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (0, 0), (3, 0), (5, 0)], "doc_id long, toxic int"))
    assert toxicity.score(d, model).count() == 5 and toxicity.keep(d, model).columns == d.columns


def test_token_files_odd(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 20)
    rows = [(None, "a b c"), (5, "x y z " * 9), (5, "k"), (7, None), (6, "word " * 30), (1, "")]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumn("id", F.lit(1)).coalesce(1)
    token_files.write(d, tokens.default_tokenizer(), f"file://{tmp_path}/o")
    got = token_files.digests(spark, f"file://{tmp_path}/o").orderBy("start").collect()
    assert [r.id for r in got] == [None, 1, 5, 5, 6, 7] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert spark.read.parquet(f"file://{tmp_path}/o").count() > 2
    token_files.write(d.where("false"), tokens.default_tokenizer(), f"file://{tmp_path}/e")
    assert token_files.digests(spark, f"file://{tmp_path}/e").count() == token_files.read(spark, f"file://{tmp_path}/e").count() == 0


def test_packing_in_parts(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 300)
    rng = random.Random(8)
    texts = {i: ". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 12))) for i in range(80)}
    seq, seen = {}, {}
    for r in packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), tokens.default_tokenizer(), limit=64).collect():
        seq.setdefault(r.sequence_id, []).append(r)
        seen.setdefault(r.id, []).append(r)
    order = [r.id for k in sorted(seq) for r in sorted(seq[k], key=lambda r: r.offset)]
    assert order == sorted(order) and len(seq) > 20
    for i, t in texts.items():
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(seen[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert all(sum(r.length for r in rs) <= 64 for rs in seq.values())


def test_language_network():
    rng = np.random.default_rng(3)
    net = language_id.Net(["a", "b", "c"])
    net.bias[:] = rng.normal(size=len(net.bias))
    x, y = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def forward():  # one-hot convolution, maximum, rectifier, linear layer
        out = []
        for row in x:
            tops = [max(sum(t[j, row[i + j], f] for j in range(w)) for i in range(language_id.WINDOW - w + 1)) for w, t in zip(language_id.WIDTHS, net.tables, strict=True) for f in range(language_id.FILTERS)]
            out.append(np.maximum(np.array(tops) + net.bias, 0) @ net.out + net.out_bias)
        return np.array(out)

    z = forward()
    assert np.allclose(net.logits(x), z, atol=1e-4)
    loss = lambda: float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(5), y]))
    grads = net._gradients(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in [tuple(int(rng.integers(0, n)) for n in p.shape) for _ in range(2)] + [np.unravel_index(int(np.abs(g).argmax()), g.shape)]:
            keep, found = p[at], []
            for step in (1e-2, -1e-2):
                p[at] = keep + step
                net._pairs, z = None, forward()
                found.append(loss())
            p[at], net._pairs = keep, None
            assert abs((found[0] - found[1]) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_language_is_learned_from_other_documents_alone(spark):
    rows = [(i, "eins zwei drei vier" if i % 2 else "one two three four", "de" if i % 2 else "en") for i in range(80)]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    lies = [(i, t, ("en" if lang == "de" else "de") if i in held else lang) for i, t, lang in rows]
    a, b = (language_id.fit(spark.createDataFrame(r, "doc_id long, text string, lang string").coalesce(1)) for r in (rows, lies))
    assert held and all((p == q).all() for p, q in zip(a.parameters(), b.parameters(), strict=True))


def test_toxicity_scores_by_dictionary():
    rng = np.random.default_rng(5)
    weights = rng.normal(size=1 << toxicity.HASH_BITS) * (rng.random(1 << toxicity.HASH_BITS) < 0.5)
    model, texts = toxicity.Model(weights, 0.3), ["", "Ab", "the idiot The idiot", "É" * 50, "x " * 400, "\U0001f600 ok"]

    def features(text):
        t, out = " " + text.lower() + " ", set()
        for n in toxicity.GRAMS:
            for i in range(len(t) - n + 1):
                h = (n + sum((ord(c) + j) * int(toxicity._K[j]) for j, c in enumerate(t[i : i + n]))) % (1 << 64)
                out.add(((h ^ h >> 29) * int(toxicity._K[0])) % (1 << 64) >> 64 - toxicity.HASH_BITS)
        return out

    want = [1 / (1 + np.exp(-np.clip(0.3 + sum(weights[f] for f in features(t)), -40, 40))) for t in texts]
    assert np.allclose(model.scores(texts), want)


def test_pipeline(spark, tmp_path, library):
    import corpus_pipeline

    rng = random.Random(6)
    words = {"en": "the and ing of to was is that with for on are".split(), "de": "der die und ist das ein nicht mit von auf".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(30, 90)))
        rows.append((i, text + (" idiot scum moron" if i % 8 == 1 else ""), lang))
    rows += [(200 + k, rows[2 * k][1].upper(), "de") for k in range(5)]  # exact copies
    rows += [(300 + k, rows[20 + 2 * k][1] + " ende", "de") for k in range(5)]  # near copies
    rows += [(400, None, "en"), (401, "", "en"), (402, "12 34 !!", None), (3, rows[3][1], "en"), (None, rows[5][1] + " more", "en")]
    docs = spark.createDataFrame([(*r, "web", 1, "z") for r in rows], "doc_id long, text string, lang string, source string, id long, sha string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 1), 1) for i in range(160)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, before, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r.doc_id, r.text) for r in now.collect()] if name != "packing" else now.collect()
        assert name == "packing" or now.columns == docs.columns
    assert sorted(map(str, kept["language_id"])) == sorted(str((i, t)) for i, t, _ in rows if i not in (400, 401, 402))
    clean = [(i, t) for i, t in kept["language_id"] if "idiot" not in t]
    assert sorted(map(str, kept["toxicity"])) == sorted(map(str, clean))
    best = {}
    for i, t in clean:
        best[_lower(t)] = max(best.get(_lower(t), -1), -1 if i is None else i)
    assert sorted((str(i), _lower(t)) for i, t in kept["exact_dedup"]) == sorted((str(None if i < 0 else i), t) for t, i in best.items())
    low = {i: c for i, _, c in _components({i: t for i, t in kept["exact_dedup"] if i is not None})}
    assert sorted(str(i) for i, _ in kept["jaccard_join"]) == sorted([*(str(i) for i, c in low.items() if i == c), *("None" for i, _ in kept["exact_dedup"] if i is None)])
    assert 200 in {i for i, _ in kept["exact_dedup"]} and len(kept["jaccard_join"]) < len(kept["exact_dedup"])
    for i, t in kept["jaccard_join"]:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        ps = sorted((r.start, r.length, r.ids_crc32) for r in kept["packing"] if r.doc_id == i)
        assert [p[0] for p in ps] == np.cumsum([0, *(p[1] for p in ps)])[:-1].tolist() and sum(p[1] for p in ps) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in ps)
