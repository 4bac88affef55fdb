import random

import numpy as np
import pytest

import corpus_pipeline
from weftgraph.llm import embedding_join, ngram_join, warc
from weftgraph.llm.components import connected


def shingles(t, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def groups(ids, linked):
    to = {i: i for i in ids}

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        to[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(rng, n):
    words = [f"w{i}" for i in range(4000)]
    docs, passage = [], [rng.choice(words) for _ in range(55)]
    for k in range(n):
        if docs and rng.random() < 0.5:
            base = rng.choice(docs)[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            docs.append(base)
        else:
            docs.append([rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 40, 120, 200]))] + (passage if rng.random() < 0.3 else []))
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(n // 3):  # a large group of near copies
        copy = base[:]
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = rng.choice(words)
        docs.append(copy)
    out = [" ".join(d) for d in docs] + [None, "", " \t ", "A B c", "a b C", "a b c"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,short,hot,chunk,few", [(1, 12, ngram_join.HOT, 256, 10**6), (2, 2, ngram_join.HOT, 3, 10**6), (1, 12, -3, 256, 10**6), (2, 4, 1, 2, 0)])
def test_jaccard_against_all_pairs(spark, monkeypatch, seed, short, hot, chunk, few):
    """hot: -3 deals every list to several tasks; few: 0 sends nothing to all executors but what is bounded."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join.C, "FEW", few)
    texts = corpus(random.Random(seed), 120)
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = groups(range(len(texts)), linked)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, hot=hot).collect()}
    assert found == {i: (len(sets[i]), expected[i]) for i in expected}


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    """First hashes of three bits: different sets get names of their own."""
    plain = ngram_join.Shingler.ids

    def short(self, found):
        ids = plain(self, found)
        return ids if ids[0] is None else (ids[0] % 8, ids[1])

    of = spark.createDataFrame([(i, i % 8, 10 * i) for i in range(40)] + [(99, 3, 30)], "doc_id long, node long, second long")
    renamed = ngram_join.namesakes(of, ngram_join.per_node(of))
    assert set(renamed) == {(i % 8, 10 * i) for i in range(8, 40)} and len(set(renamed.values())) == 32
    shingles = ngram_join.Shingler()
    monkeypatch.setattr(ngram_join.Shingler, "ids", short)
    found = shingles("a b c d e f")
    assert shingles.node(found, {shingles.ids(found): -5}) == -5 and shingles.node(found, {}) == shingles.ids(found)[0]


def test_open_pairs_are_all_that_pass(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    rng = random.Random(8)
    members = {(lst, node): (10 + node % 23, rng.randrange(4)) for node in range(60) for lst in rng.sample(range(5), 2)}
    component = {node: min(node, node % 9) for node in range(60)}
    df = spark.createDataFrame([(lst, node, n, place) for (lst, node), (n, place) in members.items()], "list long, node long, n long, place long")
    joined = spark.createDataFrame(list(component.items()), "node long, component long")
    expected = set()
    for (lst, a), (na, pa_) in members.items():
        for (other, b), (nb, pb) in members.items():
            if lst == other and a < b and component[a] != component[b] and 100 * min(na, nb) >= 75 * max(na, nb) and min(na - pa_, nb - pb) >= -(-75 * (na + nb) // 175):
                expected.add((a, b))
    found = [(r["a"], r["b"]) for r in ngram_join.open_pairs(df, joined, 75).collect()]
    first = {(a, b) for a, b in expected}
    assert len(found) == len(set(found)) and set(found) <= first
    lists_of = lambda v: {lst: members[lst, v][1] for lst in range(5) if (lst, v) in members}
    for a, b in first - set(found):  # an earlier list of both stops it
        shared = lists_of(a).keys() & lists_of(b).keys()
        assert any(min(members[x, a][0] - members[x, a][1], members[x, b][0] - members[x, b][1]) < -(-75 * (members[x, a][0] + members[x, b][0]) // 175) for x in shared)


def test_open_pairs_stop_at_parity_maps(spark, monkeypatch):
    """Of a hundred texts that share a passage but are not alike, hardly a pair goes on to the check; none that links is lost."""
    rng, shingler, checked = random.Random(5), ngram_join.Shingler(), []
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join(passage + [f"v{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(100)]
    texts += [" ".join(t.split()[:-k]) for t, k in zip(texts, range(1, 11))]
    found = [shingler(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            apart = int(np.bitwise_count((ngram_join.parities(found[a]) ^ ngram_join.parities(found[b])).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(found[a], found[b]))
    plain = ngram_join._checked

    def counting(docs, per, pairs, *rest):
        checked.append(pairs.count())
        return plain(docs, per, pairs, *rest)

    monkeypatch.setattr(ngram_join, "_checked", counting)
    # the passage's shingles are the common ones; hold the order by rarity off, so that they stand in the prefixes
    monkeypatch.setattr(ngram_join, "levels", lambda counted: bytes(ngram_join.COUNTERS))
    rows = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i if i < 100 else i - 100 for i in range(110)}
    assert sum(checked) < 1000  # of 5995 pairs


def test_jaccard_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, None), (9, long), (8, long + " y")]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7), (None, 0, None), (9, 29996, 8), (8, 29997, 8)]))
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(["5", "None", "7", "None", "8"])


def test_keep_one_with_clashing_columns(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a, "x", 5, None), (2, a + " more", "y", 6, a), (3, b, None, None, b), (3, b, "again", 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, DOC_ID int, TEXT string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    kept = sorted(map(repr, map(tuple, kept.collect())))
    assert kept[0] == repr(rows[0]) and len(kept) == 2 and kept[1] in map(repr, rows[2:])
    assert ngram_join.keep_one(spark.createDataFrame([], df.schema)).collect() == []


def test_keep_one_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, "w x y z u v w"), (8, c), (9, None), (9, ""), (9, "p q r s t u"), (3, a + " more"), (1, a + " more")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    kept = sorted((r["doc_id"], (r["text"] or "")[:4]) for r in kept.collect())
    assert kept == [(1, a[:4]), (5, b[:4]), (7, c[:4]), (7, "w x "), (9, ""), (9, "p q ")]


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_a_long_path(spark, few):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (300, 301)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected(links, few).collect()}
    assert found == dict.fromkeys(range(201), 0) | {300: 300, 301: 300}


@pytest.mark.parametrize("page,few", [(1000, 10**6), (1 << 20, 10**6), (1000, 0)])
def test_embeddings_against_all_pairs(spark, monkeypatch, page, few):
    monkeypatch.setattr(embedding_join, "PAGE_BYTES", page)
    monkeypatch.setattr(embedding_join.C, "FEW", few)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 40))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for i in range(60, 160):  # around a few, at all likenesses
        v = base[i % 7] + rng.normal(size=40) * rng.choice([0.0, 0.05, 0.2, 0.35, 0.5])
        rows.append((i, (v * rng.uniform(0.5, 2)).tolist(), int(i % 7 % 3)))
    rows += [(200, None, 1), (201, [0.0] * 40, 1), (202, [float("nan")] * 40, 1), (203, base[0].tolist(), None), (204, [None] + [1.0] * 39, 1), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1)]
    ok = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = [(a, b) for k, (a, v, y) in enumerate(ok) for b, w, z in ok[:k] if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93]
    to = groups([r[0] for r in rows], linked)
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near_duplicates(df).collect()}
    n = {r[0]: sum(r[0] in pair for pair in linked) for r in rows}
    assert found == {i: (n[i], to[i], to[i] == i) for i in to}


def test_blocks_hand_on_few_pairs():
    """Of evenly spread vectors, the union of the blocks holds far under a hundredth of all pairs, and every one that links."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x[1000:] = x[:500] + 0.2 * rng.normal(size=(500, 64))
    x = embedding_join.units(x)
    axes, variance = embedding_join.rotation(x)
    blocks, r = embedding_join.plan_blocks(variance, 0.14), x @ axes
    assert sum(b[2] for b in blocks) == pytest.approx(0.14)
    found = {(a, b) for block in blocks for i, j in embedding_join.range_join(r, r, block) for a, b in zip(i.tolist(), j.tolist()) if a < b}
    linked = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93))) if a < b}
    assert linked <= found and len(found - linked) < 0.01 * 1500 * 1499 / 2
    assert {(a, b) for i, j in embedding_join.links(x, x, (axes, blocks), 0.93, True) for a, b in zip(i.tolist(), j.tolist())} == linked


def test_embeddings_of_extreme_sizes(spark):
    base, other = [3.0, 4.0, 0.1], [4.0, -3.0, 0.1]
    rows = [(k, [v * f for v in base], 1) for k, f in enumerate((1e200, 1e-200, 1.0, 5e-324 / 0.1))] + [(9, [v * 1e-200 for v in other], 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found[0] == found[1] == found[2] and found[0][1] == 0 and found[9] == (0, 9)


def test_embeddings_empty(spark):
    assert embedding_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def records(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "record_id long, kind string, url string, at long, headers map<string,string>, status string")


@pytest.mark.parametrize("slices", [1, 4, 32])
def test_revisits_take_the_latest_earlier_response(spark, slices):
    rng = random.Random(6)
    rows = [(i, rng.choice(["response", "revisit", "other"]), f"http://{rng.choice('AB')}.org/p/", rng.randrange(40), {"etag": rng.choice("xy")}) for i in range(300)]
    found = {r["record_id"]: (r["status"], r["response_id"]) for r in warc.resolve_revisits(records(spark, rows), slices).collect()}
    for i, kind, url, at, headers in rows:
        if kind == "revisit":
            earlier = max(((r[3], r[0]) for r in rows if r[1] == "response" and r[2] == url and r[3] < at), default=None)
            assert found[i] == (("missing", None) if earlier is None else ("resolved" if rows[earlier[1]][4] == headers else "changed", earlier[1]))


def test_revisit_validators_and_headers(spark):
    rows = [
        (1, "response", "HTTP://www.A.org:80/p?utm_source=x&b=2&a=1#f", 1, {"etag": "W/t", "last-modified": "m", "content-length": "9", "expires": "old"}),
        (2, "revisit", "https://a.org/p/?a=1&b=2", 2, {"etag": "t", "content-length": "0", "expires": "new"}),
        (3, "revisit", "https://a.org/p?a=1&b=2", 3, {"last-modified": "n"}),
        (4, "revisit", "https://a.org/p?a=1&b=2", 3, None),
        (5, "revisit", None, 3, None),
        (6, "revisit", "https://a.org/p?a=1&b=2", 1, {}),
        (7, "revisit", "https://a.org/p?a=1&b=2", None, {}),
    ]
    found = {r["record_id"]: r for r in warc.resolve_revisits(records(spark, rows)).collect()}
    assert {i: r["status"] for i, r in found.items()} == {2: "resolved", 3: "changed", 4: "unvalidated", 5: "missing", 6: "missing", 7: "missing"}
    assert found[2]["headers"] == {"etag": "t", "last-modified": "m", "content-length": "9", "expires": "new"} and found[3]["headers"] is None
    assert warc.resolve_revisits(records(spark, [])).collect() == []


def test_pipeline_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, before, data).cache()
        assert after.columns == columns and 0 < after.count() <= before.count()
        if k == 2:
            sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            linked = [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            to = groups(sets, linked)
            assert {r["doc_id"] for r in after.collect()} == {i for i in to if to[i] == i}
        before = after
    packed = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
