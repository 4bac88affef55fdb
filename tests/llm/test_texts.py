import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weftgraph.llm import fingerprints as fp
from weftgraph.llm import language_id, pii, quality

DATA = "/root/testdata/sf0.001"

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda x: "".join(c for c in x if c in "0123456789")

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


def test_plain_detection_is_the_patterns():
    rng = random.Random(3)
    bits = ["a", "@", ".", "1", "12", "255", "256", "+", " ", "-", "(", ")", "b.c", "_", "%", "é", "1.2.3.4", "4111 1111 1111 1111", "+1 415 555 0100", "x@y.z"]
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.detect(t) == plain_spans(t), t


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("write john at example dot com now", "email", "john at example dot com"),
        ("jane.doe [at] example [dot] com", "email", "jane.doe [at] example [dot] com"),
        ("jane (at) mail.example.org!", "email", "jane (at) mail.example.org"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("user@ex​ample.com", "email", "user@ex​ample.com"),
        ("plus one four one five five five five zero one zero zero", "phone", "plus one four one five five five five zero one zero zero"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("four" + " one" * 15, "card", "four" + " one" * 15),
        ("vier, " + "eins, " * 14 + "eins", "card", "vier, " + "eins, " * 14 + "eins"),
        ("at 192 dot 168 dot one dot five.", "ip", "192 dot 168 dot one dot five"),
        ("write user @ example . com soon", "email", "user @ example . com"),
        ("usɑr@exɑmple.com", "email", "usɑr@exɑmple.com"),
        ("call +two(5550100 now", "phone", "+two(5550100"),
        ("call +5550100(five now", "phone", "+5550100(five"),
        ("host 10 . 0 . 0 . 7 is up", "ip", "10 . 0 . 0 . 7"),
        ("john@fünf.com", "email", "john@fünf.com"),
    ],
)
def test_disguises(text, kind, found):
    assert found in [text[a:b] for k, a, b in pii.find(text)[1] if k == kind]


def test_the_gate_loses_nothing(monkeypatch):
    rng = random.Random(12)
    words = [*pii.DIGITS, "plus", "at", "dot", "punkt", "arroba", "AT", "Five", "ſix", "fıve", "fİve", "a", "x.y", "john", "com", "55", "5550100", "1"]
    bits = [*words, *words, " ", " ", " ", "  ", "(", ")", "[", "]", "{", "<", ">", ".", " . ", "@", " @ ", "+", "-", "_", ",", ";", "—", "“", "é", "\u200b"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(2, 16))) for _ in range(40000)]
    gated = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "_hinted", lambda text: True)
    for t, found in zip(texts, gated):
        assert found == pii.find(t), t


def test_disguised_identifiers_lead_back(spark):
    """Identifiers, disguised at random and set into prose, are found from their first to their last character."""
    rng = random.Random(5)
    at, dot = [" at ", " [at] ", "(at)", "@", " @ ", "﹫", "＠"], [" dot ", " [dot] ", "(.)", ".", " . ", "․"]
    alike = {v: k for k, v in pii.LOOK_ALIKES.items() if v.isalpha()}
    disguised = lambda w: "".join(alike.get(c, c) if rng.random() < 0.2 else c + ("\u200b" if rng.random() < 0.1 else "") for c in w[:-1]) + w[-1]
    names = list(pii.DIGITS)[:10]
    rows = []
    for k in range(300):
        kind = ("email", "phone", "card", "ip")[k % 4]
        if kind == "email":
            x = disguised("mary.lee7") + rng.choice(at) + disguised("exampleshop") + rng.choice(dot) + "org"
        elif kind == "phone":
            x = "plus " + " ".join(rng.choice(names) for _ in range(11))
        elif kind == "card":
            x = " ".join(names[int(d)] if rng.random() < 0.7 else chr(0xFF10 + int(d)) for d in "4111111111111111")
        else:
            x = rng.choice(dot).join(map(str, (192, 168, rng.randrange(100), rng.randrange(100))))
        rows.append((k, f"The quiet river, they said; {x}; and then the lamps went out.", kind, x))
    found = {r["doc_id"]: r["spans"] for r in pii.pii_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for k, text, kind, x in rows:
        start = text.index(x)
        assert f"{kind}:{start}:{start + len(x)}" in found[k].split(","), (text, found[k])


@pytest.mark.parametrize("text", ["see you at noon. the end at home", "one two un deux", "meet us at example.com", "un point. deux points", "", "a (at) b"])
def test_clean_texts_stay(text):
    assert pii.find(text)[1] == []


def test_stages_with_clashing_columns(spark):
    rows = [(1, "the cat and the dog", "en", "x", 3, "TEXT"), (1, "the cat and the dog", "en", "x", 3, "TEXT"), (3, None, None, None, None, None), (4, "", "fr", "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, TEXT string, n_chars long, Text string")
    weights = np.zeros(quality.BINS, np.float32)
    for kept in (language_id.keep_known(df, firm=-9.0), quality.keep_good(df, model=(weights, np.array([-2.0, -1.0]))), pii.redact(df)):
        assert kept.columns == df.columns
        assert set(map(repr, map(tuple, kept.collect()))) <= {repr(r) for r in [*rows, (1, rows[0][1], "en", "x", 19, "TEXT")]}
    assert language_id.keep_known(df, firm=-9.0).count() == 2 and pii.redact(df).count() == 4
    for stage in (lambda d: language_id.keep_known(d, firm=-9.0), lambda d: quality.keep_good(d, model=(weights, np.array([-2.0, -1.0]))), pii.redact):
        assert stage(spark.createDataFrame([], df.schema)).collect() == []


def test_pii_query_rows(spark):
    rows = [(1, "a@b.c and x at y dot com"), (None, "1.2.3.4"), (3, None), (3, None), (4, "9" * 100_000)]
    found = pii.pii_spans(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_email int")).collect()
    assert [(r["doc_id"], r["n_email"], r["n_ip"], r["n_base"]) for r in found] == [(1, 2, 0, 1), (None, 0, 1, 1), (3, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0)]
    assert found[0]["spans"] == "email:0:5,email:10:24" and found[0]["base_sha256"] == hashlib.sha256(b"email:0:5").hexdigest()
    docs = spark.createDataFrame([(1, "mail a@b.c", "en", "s", 10), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "mail <EMAIL>", "en", "s", 12), (2, None, "en", "s", None)]


def test_fingerprints_tell_equality_and_edits():
    a = "First line. Second part, here.\nAnother line of it.\n\nNew section; more words.\n" * 3
    assert str(fp.Tree.of(a)) == str(fp.Tree.of(a)) and fp.likeness(str(fp.Tree.of(a)), str(fp.Tree.of(a))) == 1.0
    b = a.replace("Another line", "A changed line", 1)
    assert fp.Tree.of(a).root != fp.Tree.of(b).root and 0.8 < fp.likeness(str(fp.Tree.of(a)), str(fp.Tree.of(b))) < 1
    (start, end), = fp.differing(str(fp.Tree.of(b)), fp.Tree.of(a))
    assert "A changed line" in b[start:end] and end - start <= 60
    assert fp.likeness(fp.Tree.of(""), fp.Tree.of("")) == 1.0 and fp.likeness(fp.Tree.of(""), fp.Tree.of("x")) == 0.0
    back = fp.Tree.parse(str(fp.Tree.of(a)))
    assert str(back) == str(fp.Tree.of(a))


def clauses(text):
    """The clauses of a text, cut by hand: 32 bytes without a mark at most, then the marks, 32 at most."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    marks = b".!?,;:\n"
    while at < len(raw):
        end = at
        while end < len(raw) and end - at < 32 and raw[end] not in marks:
            end += 1
        first = end
        while end < len(raw) and end - first < 32 and raw[end] in marks:
            end += 1
        out.append(raw[at:end])
        at = end
    return out


def test_likeness_against_clauses_in_common():
    from collections import Counter

    rng = random.Random(7)
    words = ["ant", "bee", "élan", "dog,", "fox.", "gnu;", "hen\n", "yak\n\n", "猫", "x" * 50, "..."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 20, 300]))) for _ in range(40)]
    for a in texts:
        cut = rng.randrange(len(a) + 1)
        for b in (rng.choice(texts), a[:cut] + "changed" + a[cut:], a[cut:] + a[:cut]):
            x, y = Counter(clauses(a)), Counter(clauses(b))
            expected = 1.0 if a == b else 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))
            assert fp.likeness(str(fp.Tree.of(a)), fp.Tree.of(b)) == pytest.approx(expected)
            assert a != b or fp.differing(fp.Tree.of(a), str(fp.Tree.of(b))) == []


def test_edits_without_line_breaks_are_located():
    rng = random.Random(3)
    text = ", ".join("".join(rng.choices("abcdefghij", k=12)) for _ in range(3000))
    changed = text[:20000] + "ZZZZ" + text[20000:]
    where = fp.differing(fp.Tree.of(changed), fp.Tree.of(text))
    assert where[0][0] <= 20000 and where[-1][1] >= 20004 and where[-1][1] - where[0][0] < 2500


@pytest.mark.parametrize("ids", [[5] * 60 + list(range(20)), [None] * 40 + [1, 2], [7, 7, None, None, 3]])
def test_next_of_equal_and_null_ids(spark, ids):
    """Each document is followed by the next one by descending id, then by a hash of the text."""
    texts = [f"text number {k}, " * 9 for k in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    tie = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    expected = []
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        expected.append((i, hashlib.sha256((t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest()))
    found = [(r["doc_id"], r["edited_sha256"]) for r in fp.fingerprint_edits(df).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


@pytest.mark.parametrize("ids", [list(range(40)), [7], [], [3, 3, 3, None, None, 9], [None]])
def test_next_documents(spark, ids):
    texts = [f"text {k}. " * (k % 7 + 1) if k % 5 else None for k in range(len(ids))]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, n_chars int")
    found = fp.fingerprint_edits(df).collect()
    assert len(found) == len(ids)
    if None in ids or len(set(ids)) < len(ids):
        return
    order = sorted(zip(ids, texts), reverse=True)
    expected = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        expected[i] = (len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in found} == expected


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def plain_kernel_model(rows, ridge=1e-3):
    """(texts, languages) to values, with sets of bins, an explicit kernel and the ridge system written out."""

    def bins(text):
        codes = [ord(c) for c in "".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower())]
        found = set()
        for n in range(1, 5):
            for at in range(len(codes) - n + 1):
                mixed = 0
                for c in codes[at : at + n]:
                    mixed = ((mixed * 0x9E3779B1 % 2**32) ^ c) * 0x85EBCA6B % 2**32
                    mixed ^= mixed >> 15
                found.add(((mixed + n * 0x27D4EB2F) % 2**32) >> 17)
        return found

    def packed(found):
        row = np.zeros(language_id.BINS, np.uint8)
        row[list(found)] = 1
        return np.packbits(row).tobytes()

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    known = sorted((lang, packed(found := bins(text)), sorted(found)) for text, lang in rows)
    known = [(lang, set(found)) for lang, _, found in known]
    langs = sorted({lang for lang, _ in known})
    marks = [f for lang in langs for f in [f for x, f in known if x == lang][: language_id.LANDMARKS]]
    nm = np.array([[kernel(f, m) for m in marks] for _, f in known])
    mm = np.array([[kernel(f, m) for m in marks] for f in marks])
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in known])
    share = np.diag([1 / sum(x == lang for x, _ in known) for lang, _ in known])
    w = np.linalg.solve(nm.T @ share @ nm + ridge * mm + 1e-9 * np.eye(len(marks)), nm.T @ share @ y)
    return langs, lambda text: np.array([kernel(bins(text), m) for m in marks]) @ w


def test_language_against_an_explicit_kernel(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANDMARKS", 9)
    docs = [(r["doc_id"], r["text"][:300], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r["text"] and r["lang"]]
    learn = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 3 != 1 and language_id.has_letter(t)]
    langs, values = plain_kernel_model(learn)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    for i, t, _ in docs:
        if language_id.has_letter(t):
            v = values(t)
            assert found[i]["score"] == pytest.approx(min(1, max(0, (v.max() + 1) / 2)), abs=2e-3)
            assert found[i]["lang_pred"] == langs[int(v.argmax())] or np.sort(v)[-1] - np.sort(v)[-2] < 4e-3


def test_numbers_are_not_letters(spark):
    rows = [(i, t, "en") for i in range(20) for t in ("² ½ ① Ⅷ", "the cat sat")] + [(50, "ʰ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(df).collect()] == ["und", "en"] * 20 + ["en"]


def test_samples_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 3 != 1]
    df = spark.createDataFrame([(i, "some words", "en") for i in ids] + [(ids[0], f"more {k}", "en") for k in range(500)], "doc_id long, text string, lang string")
    assert 5 <= len(language_id.taught(df)) <= 45
    assert language_id.C.bound(300, 10**12) * 10**12 // language_id.C.LOTS in (299, 300)


def test_language_edge_rows(spark):
    rows = [(2, "the cat and the dog", "en"), (3, "le chat et le chien", "fr"), (5, None, "en"), (6, "123 ... !", "en"), (None, "the", None), (2, "the cat and the dog", "en"), (8, "ab " * 500_000, "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    found = language_id.identify(df).collect()
    assert [r["lang_pred"] for r in found][2:4] == ["und", "und"] and found[4]["held_out"] is False and len(found) == len(rows)
    assert language_id.keep_known(df).count() == 5
    empty = spark.createDataFrame([], df.schema)
    assert language_id.identify(empty).collect() == []
    untaught = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(untaught).first()["lang_pred"] == "und"


def test_unlearned_languages_go(spark):
    rng = random.Random(4)
    cyrillic = "все люди рождаются свободными и равными в своём достоинстве и правах они наделены разумом и совестью".split()
    chinese = "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待"
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto".split()
    strange = [" ".join(rng.choice(words) for _ in range(k)) for words in (cyrillic, finnish) for k in (30, 100, 400)]
    strange += ["".join(rng.choice(chinese) for _ in range(k)) for k in (30, 400)]
    strange += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(k)) for k in (30, 100, 1000)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(strange)], docs.schema)
    kept = {r["doc_id"] for r in language_id.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10**9}
    held = [r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(i in kept for i in held) >= 0.98 * len(held)


def test_long_texts_lose_no_ngram(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé ") for _ in range((1 << 20) + 5000))
    whole, parts = np.zeros(language_id.BINS, np.uint8), np.zeros(language_id.BINS, np.uint8)
    language_id.presences(text, parts)
    for at in range(0, len(text), 1000):
        language_id.presences(text[at : at + 1003], whole)
    assert (whole == parts).all()


def test_quality_held_out(spark):
    """From some 2,000 rated texts; README has the figures for more."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rated = labels.toPandas()
    learn = rated[rated.doc_id % 2 == 0]
    model = quality.train(docs, spark.createDataFrame(learn[["doc_id", "quality", "toxic"]]))
    found = {r["doc_id"]: r["selected"] for r in quality.grade_documents(docs, model=model).collect()}
    test = rated[rated.doc_id % 2 == 1]
    good = test[(test.quality == 1) & (test.toxic == 0)].doc_id
    toxic = test[test.toxic == 1].doc_id
    assert np.mean([found[i] for i in good]) >= 0.95 and np.mean([found[i] for i in toxic]) <= 0.06


def test_quality_against_plain_likelihood(monkeypatch):
    """The same steps with a dense matrix and a likelihood whose slopes are taken by differences."""
    rng = random.Random(2)
    words = [["scum", "trash", "hate"], ["meh", "okay", "thin"], ["fine", "lucid", "prose"]]
    texts = [(g, " ".join(rng.choice(words[g] if rng.random() < 0.8 else sum(words, [])) for _ in range(6))) for g in (0, 1, 2, 2, 1, 0) * 6]
    rows = [(g, quality.packed(t)) for g, t in texts]
    monkeypatch.setattr(quality, "UNEVEN", 0.0)
    weights, cuts = quality.fit(rows, rounds=40)
    rows.sort()
    bins = [set(np.frombuffer(b, "<i4").tolist()) for _, b in rows]
    used = sorted(b for b in set().union(*bins) if sum(b in x for x in bins) >= 2)
    x, grade = np.array([[float(b in s) for b in used] for s in bins]), [g for g, _ in rows]
    count = {g: grade.count(g) for g in grade}

    def loss(v):
        w, low, gap = v[:-2], v[-2], v[-1]
        at = [-np.inf, low, low + np.exp(gap), np.inf]
        below = lambda t, f: 1 / (1 + np.exp(f - t)) if np.isfinite(t) else float(t > 0)
        fit = -sum(np.log(below(at[g + 1], f) - below(at[g], f)) / (count[g] * len(count)) for g, f in zip(grade, x @ w))
        return fit + 3e-3 * (w @ w) / (2 * len(used))

    v, m, s = np.array([*np.zeros(len(used)), -1.0, np.log(2.0)]), 0.0, 0.0
    for step in range(1, 41):
        g = np.array([(loss(v + h) - loss(v - h)) / 2e-5 for h in 1e-5 * np.eye(len(v))])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        v = v - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(weights[used], v[:-2], atol=2e-3) and np.allclose(cuts, [v[-2], v[-2] + np.exp(v[-1])], atol=2e-3)
    assert np.flatnonzero(weights).tolist() == [b for b, w in zip(used, weights[used]) if w]
    for _, t in texts[:12]:  # and what the grades say
        f = sum(float(weights[quality.bin_of(w)]) for w in quality.features(t))
        above = [1 / (1 + np.exp(c - f)) for c in cuts]
        grade_, good = quality.Grader((weights, cuts))([t])
        assert grade_[0] == pytest.approx(sum(above)) and good[0] == pytest.approx(above[1])


def test_quality_thresholds_are_ordered_and_edge_rows(spark):
    rows = [(1, quality.packed("good words here")), (2, quality.packed("fine prose here")), (0, quality.packed("scum scum"))] * 5
    weights, cuts = quality.fit([(g, b) for g, b in rows])
    assert cuts[0] < cuts[1]
    df = spark.createDataFrame([(1, "fine prose here", 3), (2, None, 1), (None, " ", 2), (1, "fine prose here", 3)], "doc_id long, text string, selected int")
    found = quality.grade_documents(df, model=(weights, cuts)).collect()
    assert len(found) == 4 and [r["p_good"] for r in found[1:3]] == [0.0, 0.0] and found[0] == found[3]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.grade_documents(df, none).count() == 4
