"""Near-duplicates, repeated passages and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kinspark.llm import imatch, neardup, suffixes, text as T

from .conftest import words

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_all_pairs(docs, texts, scratch, width):
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    want = components(sets)
    got = neardup.near_duplicates(docs, scratch, width).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("few", [4096, 4])
def test_a_family_whose_members_differ_more_than_from_their_parent(spark, scratch, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)  # 4: buckets are dealt out further, and compared in blocks
    rng = random.Random(9)
    base = words(rng, 300, 5000)
    rows = [(500, " ".join(base))]
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(300), 6):
            w[at] = f"new{k}x{at}"
        rows.append((k, " ".join(w)))
    sets = {i: shingle_set(t, 4) for i, t in rows}
    want = components(sets)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("few", [4096, 3])
def test_unlike_texts_around_one_template(spark, scratch, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    rng = random.Random(12)
    template = words(rng, 120, 10**6)
    rows = []
    for k in range(50):
        own = words(rng, 60, 10**6)
        rows += [(f"d{3 * k + j:03d}", " ".join(template + own[: len(own) - 4 * j] + words(rng, 4 * j, 10**6))) for j in range(3)]
    rows.append(("a", None))
    sets = {i: shingle_set(t, 4) for i, t in rows}
    want = components(sets)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), scratch, 4).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 40


def test_one_row_of_each_group_stays(docs, texts, scratch):
    kept = neardup.keep_first(docs, scratch)
    assert kept.columns == docs.columns
    want = components({i: shingle_set(t, 5) for i, t in texts.items()})
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_rows_that_repeat_an_id_with_other_texts_stay(spark, scratch):
    rng = random.Random(9)
    own, other, third = (" ".join(words(rng, 100)) for _ in range(3))
    near = own.rsplit(" ", 1)[0] + " changed"
    rows = [(1, own), (2, near), (2, other), (3, third), (3, third), (4, ""), (4, other + " more"), (5, near)]
    got = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    assert sorted(map(tuple, got.collect())) == [(1, own), (2, other), (3, third), (4, "")]


def test_null_ids_and_empty_tables(spark, no_docs, scratch):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = neardup.near_duplicates(df, scratch, 4).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (2, 2, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert neardup.keep_first(df, scratch).count() == 4
    assert neardup.near_duplicates(no_docs, scratch).collect() == []


def test_extremes_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 62, 800).astype(np.uint64))
    b = np.concatenate([a[:700], np.unique(rng.integers(0, 1 << 62, 100).astype(np.uint64))])
    same = np.mean(neardup.signature(np.sort(a)) == neardup.signature(np.sort(b)))
    assert abs(same - 700 / 900) < 0.15


def plain_removal(texts, length=200):
    """Digest of what is left of each text, counted window by window."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2_000, 1])
def test_repeats_match_window_counting(spark, docs, texts, scratch, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)  # 1: every mixed bucket is cut, down to single windows
    ids = list(texts) + [3]
    want = sorted(zip(ids, plain_removal([texts[i] for i in ids])))
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffixes.remove_repeats(docs, scratch).collect())
    assert got == want


def test_stripped_documents_keep_their_columns(docs, texts, scratch, no_docs):
    got = suffixes.strip_repeats(docs, scratch)
    assert got.columns == docs.columns and got.count() == len(texts) + 1
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[503].text == "one two three" and rows[0].text == "" and rows[0].n_chars == 0 and rows[10].score == "s"
    assert suffixes.remove_repeats(no_docs, scratch).collect() == []


def test_bytes_of_strips_are_not_written(docs, texts, scratch, monkeypatch):
    seen, keep = [], type(scratch).keep
    monkeypatch.setattr(type(scratch), "keep", lambda self, df, name, *more: seen.append(name) or keep(self, df, name, *more))
    assert suffixes.strip_repeats(docs, scratch).count() == len(texts) + 1
    assert "flagged" in seen and "bytes" not in seen


def test_bucket_refinement_matches_a_dictionary():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"ab") for _ in range(260))
    pool = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(200, 300))) for _ in range(20)]
    pool += [shared, b"x" * 20 + shared[30:250] + b"y" * 5, b"z" * 230]
    seen = {}
    for c in pool:
        for i in range(len(c) - 199):
            seen[c[i : i + 200]] = seen.get(c[i : i + 200], 0) + 1
    for c, flags in zip(pool, suffixes.repeated_windows(pool, 200)):
        assert flags.tolist() == [seen[c[i : i + 200]] > 1 for i in range(len(c) - 199)]
    weights = [2 if k % 7 == 0 else 1 for k in range(len(pool))]
    for c, w, flags in zip(pool, weights, suffixes.repeated_windows(pool, 200, weights)):
        assert flags.tolist() == [w > 1 or seen[c[i : i + 200]] > 1 for i in range(len(c) - 199)]
    assert suffixes.repeated_windows([], 200) == []


@pytest.mark.parametrize("crowd", [2_000, 5])
def test_many_copies_and_one_passage_in_unlike_texts(spark, scratch, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = random.Random(4)
    copy, passage = " ".join(words(rng, 60, 10**6)), " ".join(words(rng, 35, 10**6))
    rows = [copy] * 3000
    rows += [" ".join(words(rng, 40, 10**6)) + " " + passage + " " + " ".join(words(rng, 40, 10**6)) for _ in range(40)]
    rows += ["short " + copy[:250], copy[40:199] + " other", passage[:199]]
    want = plain_removal(rows)
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), scratch).collect()
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == list(enumerate(want))


def test_kept_bytes_and_ranges(spark, texts, docs, scratch):
    got = {r.doc_id: r for r in suffixes.kept_bytes(docs, scratch).collect()}
    for i, want in zip(texts, plain_removal([texts[i] for i in [*texts, 3]])):
        r, raw = got[i], (texts[i] or "").encode()
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == want[3] and len(r.ranges) == want[2]
        assert suffixes.rest(raw, r.ranges) == bytes(r.kept)


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    first, size, off, gram, _ = suffixes.runs(data, 200)
    assert (off >= 0).all() and (off - size + 1 >= 0).all() and (off <= 152).all()
    assert first[0] == 0 and (first[1:] == first[:-1] + size[:-1]).all() and first[-1] + size[-1] == 5000 - 199
    assert len(suffixes.runs(data[:199], 200)[0]) == 0
    joined = suffixes.runs(data, 200, np.array([1000, 1100, 3000, 5000]))
    parts = [suffixes.runs(data[a:b], 200) for a, b in ((0, 1000), (1100, 3000), (3000, 5000))]
    for k in (1, 2, 3, 4):
        assert joined[k].tolist() == np.concatenate([p[k] for p in parts]).tolist()
    assert joined[0].tolist() == np.concatenate([p[0] + a for p, a in zip(parts, (0, 1100, 3000))]).tolist()


def test_fingerprints(spark, docs, texts, no_docs):
    lexicon = imatch.build_lexicon(docs, 0.01, 0.5)
    got = {}
    for r in imatch.fingerprint_documents(docs, lexicon, 5).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted([*texts, 3])
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        assert any(r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() for r in got[i])
    assert got[100][0].fingerprint == got[0][0].fingerprint and got[100][0].near_next == 1.0
    plain = [r[0] for i, r in got.items() if i < 39 and i not in (2, 3)]  # 3 is there twice
    edited, after = (np.median([r[c] for r in plain]) for c in ("near_edited", "near_next"))
    assert edited > 0.3 and edited > after + 0.15
    assert imatch.fingerprint_documents(no_docs, lexicon, 3).collect() == []
    assert len(imatch.build_lexicon(no_docs)) == 0


def plain_fingerprint(text, lexicon):
    """I-Match by its definition, on Python integers."""
    big = 1 << 64

    def mix(x):
        x %= big
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % big
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % big
        return x ^ x >> 31

    found = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or ""))
    by_hash = {}
    for w in found:
        chunk = T.Chunk([w.encode()])
        start, end, _ = chunk.runs(imatch.OUTSIDE)
        by_hash[int(chunk.hashes(start, end, lower=True)[0])] = w
    own = sorted(h for h in by_hash if h in lexicon)
    tag = 0 if own else 0x5DEECE66D
    own = own or sorted(by_hash)
    out = []
    for shift in imatch.RATES:
        for j in range(imatch.SUBSETS):
            inside = [h for h in own if mix(h + mix(j + 1)) < 1 << 64 - shift]
            total = sum((mix(h + 0x2545F4914F6CDD1D) ^ tag) * pow(T._BASE, k, big) for k, h in enumerate(inside)) % big
            out.append(max(mix(total) >> 32, 1) if inside else 0)
    return out


def test_fingerprints_follow_their_definition(spark, docs, texts):
    lexicon = imatch.build_lexicon(docs, 0.01, 0.5)
    got = {r.doc_id: r for r in imatch.fingerprint_documents(docs, lexicon).collect()}
    known = set(lexicon.tolist())
    for i in [0, 1, 3, 200, 300, 400, 401, 500, 501, 503, 504, 506, 507, 508]:
        want = plain_fingerprint(texts[i], known)
        assert [int(got[i].fingerprint[8 * k : 8 * k + 8], 16) for k in range(len(want))] == want


def test_next_documents_across_ranges_of_any_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "é", None, "zz"]), " ".join(words(rng, rng.randrange(3, 30)))) for _ in range(60)] + [("b", "same text here")] * 9
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    for parts in (1, 7, 40):
        got = imatch.fingerprint_documents(df, imatch.build_lexicon(df, 0.01, 0.9), parts).collect()
        assert len(got) == len(rows)
        order = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", spark_hash(spark, r[1])))]
        want = Counter()
        for k, t in enumerate(order):
            n, after = len(t) // 4, order[(k + 1) % len(order)]
            want[hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()] += 1
        assert Counter(r.edited_sha256 for r in got) == want


_hashes = {}


def spark_hash(spark, text):
    if text not in _hashes:
        _hashes[text] = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t)").first()[0]
    return _hashes[text]


def test_lexicon_counts_documents(spark):
    df = spark.createDataFrame([(1, "Red red blue"), (2, "red green"), (3, None)], "doc_id long, text string")
    assert sorted(r.n for r in imatch.document_frequencies(df).collect()) == [1, 1, 2]


def test_single_row_is_its_own_next(spark):
    df = spark.createDataFrame([(7, "alpha beta gamma delta")], "doc_id long, text string")
    r = imatch.fingerprint_documents(df, imatch.build_lexicon(df), 3).first()
    assert r.near_next == 1.0 and r.n_chars == 22
