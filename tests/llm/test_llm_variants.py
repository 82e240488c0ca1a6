"""Spelling variants against brute force; split shards, long runs, accents, deleted letters."""

import random
import re
import zlib

import pytest

from brickyard.llm import variants


def _near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) > len(v):
        u, v = v, u
    k = 0
    while k < len(u) and u[k] == v[k]:
        k += 1
    return u[k + 1:] == v[k + 1:] if len(u) == len(v) else u[k:] == v[k + 1:]


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _variants(docs):
    n = {}
    for i, text in docs:
        for run in map(_low, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if k >= 3}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def _rows(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr(
        "*", "1 AS word", "2 AS n", "3 AS root", "4 AS family")
    got = variants.spelling_variants(frame, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()))


def _texts(seed, letters, count):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(60)]
    docs = []
    for i in range(count):
        run = []
        for w in rng.choices(words, [1 / (k + 1) for k in range(60)], k=40):
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(["", rng.choice(letters), w[p] + rng.choice(letters)]) + w[p + 1:]
            run.append(w.upper() if rng.random() < 0.2 else w)
        docs.append((i if i % 7 else None, rng.choice([" ", "-", "\n1"]).join(run)))
    return docs


@pytest.mark.parametrize("letters, shard", [("abc", 1 << 15), ("aébÿ×", 16), ("abcdefgh", 4)])
def test_variants_equal_brute_force(spark, letters, shard):
    docs = _texts(len(letters), letters, 60) + [(3, None), (4, ""), (5, "ab É ß!"), (5, "ab É ß!")]
    assert _rows(spark, docs, shard_words=shard) == _variants(docs)


def test_very_long_runs_and_runs_of_one_letter(spark):
    docs = [(i, "x" * 30_000 + " " + "x" * 30_001 + " xxxxx xxxxxx " + "ab" * 40 + " " + "ab" * 40 + "a") for i in range(6)]
    docs += [(9, "xxxxx xxxxx"), (10, "word " * 50_000)]
    got = _rows(spark, docs)
    assert [(r[0][:9], len(r[0]), *r[3:5]) for r in got] == [
        (w[:9], len(w), n, k) for w, _, _, n, k, _ in _variants(docs)]


def test_checksums_delete_the_named_letter(spark):
    hit = [i for i in range(20_000) if zlib.crc32(f"{i}:spelling".encode()) % 97 == 0]
    docs = [(i, "Spelling") for i in hit] + [(i, "spelling") for i in range(400)]
    assert _rows(spark, docs) == _variants(docs)
    assert len(_variants(docs)) > 1


def test_forms_lead_to_a_root_over_many_steps(spark):
    words = ["aaaaaaaaaa"[:10 - i] + "b" * i for i in range(8)]
    docs = [(None, w) for k, w in enumerate(words) for _ in range(3 * 2**k)]
    got = {r[0]: r for r in _rows(spark, docs)}
    assert _rows(spark, docs) == _variants(docs) and got[words[0]][2] == words[-1]


def test_no_words(spark):
    assert _rows(spark, []) == [] and _rows(spark, [(1, None), (2, "a b c")]) == []


def test_search_schemes_find_each_pair_once(monkeypatch):
    rng = random.Random(5)
    for verify in (0, 1, 64):
        monkeypatch.setattr(variants, "VERIFY", verify)
        words = sorted({"".join(rng.choice("ab\xff") for _ in range(rng.randint(5, 9))) for _ in range(150)})
        held = [w.encode("latin-1") for w in words]
        asking, got = held[::2], []
        for front in (True, False):
            got += [(int(i), int(j)) for i, j in zip(*variants.near_words(held, asking, front))]
        assert sorted(got) == [(i, j) for i, u in enumerate(asking) for j, v in enumerate(held) if _near(u, v)]
