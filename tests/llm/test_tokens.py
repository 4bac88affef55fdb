import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from weftgraph.llm import _common as C
from weftgraph.llm import byte_bpe, packing, token_counts

STRANGE = ["नमस्ते", "สวัสดี", "ⴰⵣⵓⵍ", "𝟙𝟚", "𞤀", "᠋", "\u0600", "\u2e80", "𒀀", "👍🏽", "\U000e0041", "\u0378", "\ufdd0", "ꙮ", "\u1680", "Ⴀ", "᭐", "৴", "꠰", "𐄇"]
BITS = [*STRANGE, "a", "aa", "aaa", "b", "é", "ß", "東京", "😀", " ", "  ", "\n", "\n \n", "'s", "'ll", "1", "12345", "<|endoftext|>", "\x1c", "՘", "...", "!?", "The", " the", "0" * 50, "ab" * 30, "​", "\t", "\xa0", "ⅷ", "٣", "İ", "Σ", "½", "<|ENDOFTEXT|>"]


def texts(n: int = 400) -> list[str]:
    rng = random.Random(1)
    return ["", "x" * 30000, "the " * 9000, *("".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n))]


def table(spark, rows):
    """doc_id and text among columns that clash with results and names in other case."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, TEXT string, n_tokens int")


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_compared_code_points_split_alike():
    library, find, inside = Tokenizer.from_file(P.path("byte_bpe_50k.json")), regex.compile(P.PATTERN).findall, regex.compile(f"[{C.COMPARED}]").match
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000 and inside(chr(i)):
            x = f"a{chr(i)}1\n{chr(i)}b{chr(i)}'s"
            assert [x[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(x)] == find(x), hex(i)


def test_encoding_is_the_librarys(spark, library):
    rows = [*enumerate(texts()), (None, "a b"), (5, None), (5, None)]
    found = byte_bpe.encode(table(spark, rows), None).collect()
    plain = lambda pairs: sorted(map(repr, pairs))
    assert plain((r["doc_id"], r["ids"]) for r in found) == plain((key, library.encode_ordinary(t or "")) for key, t in rows)
    back = byte_bpe.decode(byte_bpe.encode(table(spark, rows))).collect()
    assert plain((r["doc_id"], bytes(r["bytes"])) for r in back) == plain((key, (t or "").encode()) for key, t in rows)
    assert byte_bpe.encode(table(spark, [])).collect() == []


@pytest.mark.parametrize("chars,shared", [(8_000_000, 200_000), (300, 30), (300, 0)])
def test_round_trip_digests(spark, library, monkeypatch, chars, shared):
    """All, some and none of the words replayed once for all parts."""
    monkeypatch.setattr(byte_bpe.C, "BLOCK_CHARS", chars)
    monkeypatch.setattr(byte_bpe, "SHARED", shared)
    found = {r["doc_id"]: r for r in byte_bpe.round_trip(table(spark, enumerate(texts(50)))).collect()}
    for k, t in enumerate(texts(50)):
        r, ids = found[k], library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_words_of_several_parts_are_shared(spark, library):
    docs = spark.createDataFrame([(k, f"zyzzyx the qwvq{k} zyzzyx") for k in range(8)], "doc_id long, text string").repartition(4)
    path = P.path("byte_bpe_50k.tiktoken")
    assert {bytes(r["word"]) for r in byte_bpe.word_parts(docs, path).filter("parts > 1").collect()} >= {b"zyzzyx", b" zyzzyx"}
    shared = byte_bpe.shared_words(docs, path)
    assert b" the" not in shared and all(np.frombuffer(v, "<u4").tolist() == library.encode_ordinary(k.decode()) for k, v in shared.items())


def test_replay_of_untrained_ranks():
    """Ranks under which a merge makes a pair of a lower rank, which no training gives."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"aba", b"ba", b"aa", b"aaa", b"cab"]
    replay = byte_bpe.MergeReplay({t: i for i, t in enumerate(tokens)})
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(500)]

    def slow(word):
        if word in replay.ranks:
            return [replay.ranks[word]]
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((replay.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in replay.ranks), default=None)
            if best is None:
                return [replay.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert [np.frombuffer(x, "<u4").tolist() for x in replay.encode(words)] == [slow(w) for w in words]


def test_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*enumerate(texts()), (None, "a b"), (5, None)]
    found = token_counts.token_counts(table(spark, rows), limit=100).collect()
    for (key, t), r in zip(rows, found, strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(r) == (key, len((t or "").encode()), n, n > 100)
    assert token_counts.token_counts(table(spark, [])).collect() == []


def test_whole_tokens_are_proven():
    library, whole, special = token_counts.proven(P.path("byte_bpe_50k.json"))
    sample = sorted(whole)[::500]
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in sample) and not whole & set(special)


def placed(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= capacity
    return by


def test_packing(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [*enumerate(texts()), (None, "a b"), (5, None), (5, None)]
    found = packing.pack(table(spark, rows), capacity=64).collect()
    expected = []
    import zlib

    for key, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(key, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted(map(repr, (tuple(r)[:5] for r in found))) == sorted(map(repr, expected))
    by = placed(found, 64)
    assert len(by) <= 1.02 * -(-sum(r["length"] for r in found) // 64) + 1
    assert packing.pack(table(spark, [])).collect() == []


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for capacity in (10, 37):
        counts = {n: rng.randint(1, 60) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
        rooms: list[int] = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [r for r in rooms if r >= n]
                if fits:
                    rooms.remove(min(fits))
                    rooms.append(min(fits) - n)
                else:
                    rooms.append(capacity - n)
        plan = packing.plan_best_fit(counts, capacity)
        used, seen = {}, {}
        for length, low, high, first, each, slot in plan:
            assert seen.get(length, 0) == low
            seen[length] = high
            for k in range(high - low):
                used.setdefault(first + k // each, []).append((slot + k % each * length, length))
        assert seen == counts and len(used) == len(rooms)
        for slots in used.values():
            end = 0
            for offset, length in sorted(slots):
                assert offset == end
                end += length
            assert end <= capacity


def test_clusters_need_a_shared_folder():
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master, folder = "spark://head:7077", None
            getCheckpointDir = classmethod(lambda cls: cls.folder)  # noqa: N815
            setCheckpointDir = classmethod(lambda cls, folder: setattr(cls, "folder", folder))  # noqa: N815

    with pytest.raises(RuntimeError):
        C.shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "/shared/x"}
    assert C.shared_folder(Session) == "/shared/x"
