"""Tokenizing, packing, license and URL filters."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinspark.llm import bpe, licenses, packing, pretoken, urls
from kinspark.llm.queries import BASE_PHRASES, URL_RULES, tokenizer

tokenizers = pytest.importorskip("tokenizers")
ODD = ["a  b", "  x", " x", " x y", "y ", "\n\nz", "a\n\nb", " ", "a\tb c", "ΑΣ ΟΔΟΣ", "İx", "<|endoftext|> foo", "a <|startoftext|>b", "é é", "x\x1cy z\x1f", "it's they'LL don't 'S", "½ ² 12345 ①", "日本語 テキスト", "🙂🙂 ok", "a\xa0b", "q\x85r", "naïve—dash…", "ﬁ ǅ ẞ", "퟿", "w.\nThe next, line."]


def test_encoding_matches_the_library(spark, docs, texts):
    path = tokenizer("word_bpe_49k.json")
    own, library = bpe.load(path), tokenizers.Tokenizer.from_file(path)
    for x in [*ODD, *(t for t in texts.values() if t)]:
        want = library.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(x), "<u4").tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    assert own.decode([0, 10**6, 1]) == own.decode([0, 1])
    rows = {r.doc_id: r for r in bpe.encode_texts(docs, path, ids=True).collect()}
    assert rows[501].n_tokens == 0 and rows[501].ids_sha256 == hashlib.sha256(b"").hexdigest() and rows[501].decoded == ""
    assert all(len(r.ids) == r.n_tokens for r in rows.values())
    for i, x in texts.items():
        want = library.encode(x or "", add_special_tokens=False).ids
        assert rows[i].ids == want and rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_segments_encode_as_the_whole(spark, texts, monkeypatch):
    long = " ".join(t for t in [*texts.values(), *ODD] if t)
    assert "".join(pretoken.segments(long, 700)) == long and len(list(pretoken.segments(long, 700))) > 20
    assert list(pretoken.segments("x" * 5000, 700)) == ["x" * 5000] and list(pretoken.segments("", 700)) == [""]
    monkeypatch.setattr(bpe, "segments", lambda x: pretoken.segments(x, 700))
    monkeypatch.setattr(packing, "segments", lambda x: pretoken.segments(x, 700))
    whole = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode(long, add_special_tokens=False).ids
    assert np.frombuffer(packing.load(tokenizer("byte_bpe_50k.json")).encode(long), "<u4").tolist() == whole
    library = tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = library.encode(long, add_special_tokens=False).ids
    own = bpe.load(tokenizer("word_bpe_49k.json"))
    parts = [np.frombuffer(own.encode(x), "<u4").tolist() for x in pretoken.segments(long, 700)]
    assert sum(parts, []) == want and " ".join(own.decode(x) for x in parts) == library.decode(want, skip_special_tokens=False)


def test_merges_follow_rank_and_place():
    ranks = {1 << 20 | 1: 0, 5 << 20 | 1: 1}
    assert bpe.merge_word([1, 1, 1], ranks, [5, 6]) == [6]
    assert bpe.merge_word([1, 1, 1, 1], ranks, [5, 6]) == [5, 5]
    assert bpe.merge_word([2], ranks, [5, 6]) == [2]


def test_byte_encoding_matches_the_library(texts):
    path = tokenizer("byte_bpe_50k.json")
    own, library = packing.load(path), tokenizers.Tokenizer.from_file(path)
    for x in [*ODD, *(t for t in texts.values() if t)]:
        assert np.frombuffer(own.encode(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids


def check_plan(counts, size=1024):
    plan = packing.plan(dict(counts), size)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= size and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    return sum(t for _, t in plan)


def test_plans_use_every_piece():
    rng = np.random.default_rng(0)
    for n in (1, 5, 300, 20_000):
        lengths = np.minimum(rng.lognormal(5.5, 1.2, n).astype(int) + 1, 1024)
        bins = check_plan(Counter(lengths.tolist()))
        if n == 20_000:
            assert bins <= 1.01 * -(-lengths.sum() // 1024)
    assert check_plan({512: 10**9}) == 5 * 10**8
    assert check_plan({1024: 7}) == 7
    assert check_plan({1000: 3, 24: 1, 12: 4}) == 3
    assert packing.plan({}) == []


def test_exact_quadruples_are_found():
    assert check_plan({500: 1, 300: 1, 200: 1, 24: 1}) == 1


def fewest(lengths, size):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        tried = set()
        for i, b in enumerate(bins):
            if b + lengths[k] <= size and b not in tried:
                tried.add(b)
                place(k + 1, [*bins[:i], b + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_plans_are_near_the_fewest():
    rng = np.random.default_rng(6)
    spare = 0
    for _ in range(60):
        lengths = sorted(rng.integers(1, 33, rng.integers(1, 11)).tolist(), reverse=True)
        got, least = check_plan(Counter(lengths), 32), fewest(lengths, 32)
        assert got <= least + 1
        spare += got - least
    assert spare <= 6


def test_sums_fill_gaps_exactly():
    rng = np.random.default_rng(8)
    for _ in range(200):
        left = dict(Counter(rng.integers(1, 40, rng.integers(1, 7)).tolist()))
        sums = packing.Sums(left, 64)
        flat = [n for n, c in left.items() for _ in range(c)]
        n = flat[0]
        rest = [*flat[1:]]
        possible = any(n + sum(c) == 64 for k in (1, 2, 3) for c in itertools.combinations(rest, k))
        found = sums.fill(n, 64 - n)
        assert (found is not None) == possible
        assert found is None or (n + sum(found) == 64 and not Counter((n, *found)) - Counter(flat))


def test_packing_whole_documents(spark, docs, texts, scratch, no_docs):
    path = tokenizer("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(docs, path), scratch).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        own = sorted(own, key=lambda r: r.piece)[:: 2 if i == 3 else 1]
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= 1024 and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(packing.pieces(no_docs, path), scratch).collect() == []


LICENSE_TEXTS = {
    1: "Released under the MIT License. Released UNDER-THE mit/license!",
    2: "Licensed under the Apache License, Version 2.0.",
    3: "cc by nc cc by nc x CC-BY-NC 4.0",
    4: "GNU General Public License, version 3.",
    5: "GNU Lesser General Public License version 2.1",
    6: "SPDX-License-Identifier: BSD-3-Clause",
    7: "undér the mit license, under the mít license",
    8: "nothing here",
    9: None,
    10: "",
    11: "under the\nmit\tlicense",
    12: "underthe mit license under the mit licenses",
    13: "All rights reserved. The Eclipse Public License v 2.0 and the zlib license",
    14: "CC BY-NC-SA 4.0",
}


def test_base_phrases_match_plain_search(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in LICENSE_TEXTS.items()] * 2, "doc_id long, text string, labels string")
    rows = licenses.scan_licenses(df, BASE_PHRASES).collect()
    assert len(rows) == 2 * len(LICENSE_TEXTS)
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    got = {r.doc_id: r for r in rows}
    for i, t in LICENSE_TEXTS.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        at, labels = [], set()
        for phrase, label in BASE_PHRASES.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_rules_and_suppression(spark):
    df = spark.createDataFrame(list(LICENSE_TEXTS.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, BASE_PHRASES).collect()}
    labels = {i: got[i].labels for i in got}
    assert labels[4] == "gpl-3" and labels[5] == "lgpl-2" and labels[6] == "bsd-3" and labels[8] == labels[9] == labels[10] == ""
    assert labels[13] == "epl-2,proprietary,zlib"
    assert "apache" not in labels[2].split(",")  # within the longer detection
    assert [(d.first_word, d.last_word) for d in got[2].detections] == [(0, 7)]
    assert "cc-by-nc-sa" in labels[14].split(",")
    assert len(licenses.rule_table(BASE_PHRASES)) > 600
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), BASE_PHRASES).collect() == []


def strings_of(tree):
    """Every string that a parsed pattern of finite length can match; assertions are left out."""
    out = [""]
    for kind, arg in tree:
        name = str(kind)
        if name == "LITERAL":
            new = [chr(arg)]
        elif name == "IN":
            new = [chr(c) for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
        elif name == "BRANCH":
            new = [x for t in arg[1] for x in strings_of(t)]
        elif name == "SUBPATTERN":
            new = strings_of(arg[3])
        elif name == "MAX_REPEAT":
            assert arg[:2] in ((0, 1), (4, 4))
            new = ["", *strings_of(arg[2])] if arg[0] == 0 else ["1999"]
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            new = [""]
        out = [a + b for a in out for b in new]
    return out


def test_every_match_holds_a_keyword_of_its_rule_and_of_the_gate():
    gate = set(licenses.gate_words(BASE_PHRASES))
    names = {label: strings_of(re._parser.parse(name)) for label, (_, name, _) in licenses.LICENSES.items()}
    for priority, label, keywords, pattern, _ in licenses.rule_table(BASE_PHRASES):
        # a grant is made of its name and a phrase before it: the name must do
        for x in names[label] if priority > 2 else strings_of(re._parser.parse(pattern)):
            assert any(k in f" {x} " for k in keywords), (label, x)
            assert gate & set(x.split()), (label, x)


def test_every_rule_finds_its_own_strings(spark):
    names = {label: strings_of(re._parser.parse(name)) for label, (_, name, _) in licenses.LICENSES.items()}
    rows = []
    for priority, label, _, pattern, _ in licenses.rule_table(BASE_PHRASES):
        found = [f"licensed under the {x}" for x in names[label]] if priority == 3 else names[label] if priority == 4 else strings_of(re._parser.parse(pattern))
        for x in {min(found, key=len), max(found, key=len)}:
            rows.append((len(rows), f"Some {x.upper()}, then: more", label, re.compile(pattern)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, BASE_PHRASES).collect()}
    assert len(rows) > 600
    by_label = {}
    for k, x, label, pattern in rows:
        words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())) + " "
        assert pattern.search(words), (label, x)
        own = got[k].labels.split(",")
        if label not in own:  # only a longer detection, or one of higher priority over the same words, may take its place
            d = got[k].detections
            at = pattern.search(words)
            first = words[: at.start()].count(" ") - 1
            assert any(e.first_word <= first and e.last_word >= first + at.group().count(" ") for e in d), (label, x, d)
        by_label.setdefault(label, []).append(label in own)
    never = [label for label, found in by_label.items() if not any(found)]
    assert len(by_label) > 175 and not never, never


def test_distinct_signatures_are_some_hundreds():
    hand_written = {name for _, name, _ in licenses.LICENSES.values()} | {text for _, _, text in licenses.TEXTS}
    assert len(hand_written) > 300 and len({label for label, _, _ in licenses.TEXTS} | set(licenses.LICENSES)) > 175


def test_long_names_need_no_other_words(spark):
    want = {
        "This work is licensed under a Creative Commons Attribution Share Alike 4.0 license.": "cc-by-sa",
        "Creative Commons Zero": "cc0",
        "Licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "a Creative Commons Attribution Non Commercial 4.0 license": "cc-by-nc",
        "Creative Commons Attribution No Derivatives": "cc-by-nd",
        "Creative Commons Attribution NonCommercial ShareAlike": "cc-by-nc-sa",
        "Creative Commons Attribution NonCommercial NoDerivs": "cc-by-nc-nd",
        "CeCILL version 2.1": "cecill-2",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(df, BASE_PHRASES).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


URLS = ["https://WWW.Example.com/en/1?x", "http://m.example.com/en/2", "https://a.net/es/x#y", "https://net/fr/", "https://a.org/es/", "no scheme", None, "ftp://x.com", "http://x.com/", "http://examplenet/es/", "https://bad.org/a/", "http://www.bad.org/a", "https://bad.org/b", "http://ok.org/redirect?u=http://bad.org/a", "://"]


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = max((r for r in URL_RULES if ("." + host).endswith("." + r[1]) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    key = host.removeprefix("www.") + path.rstrip("/") if host else None
    return host, path, best and best[1] + best[2], best[0] if best else "block" if key in listed else "allow"


def test_url_verdicts_match_plain_rules(spark, scratch):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)] + [(99, URLS[10], "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://bad.org/a",), ("http://www.bad.org/a/?q",), (None,)], "url string")
    got = urls.judge_urls(pages, listed, URL_RULES, scratch).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[10] if r.page_id == 99 else URLS[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url, {"bad.org/a"})
        assert r.possible or not r.listed


def test_filter_lets_listed_urls_through_and_few_others(spark, scratch):
    listed = spark.range(3000).selectExpr("concat('https://l', id, '.org/x') as url")
    pages = listed.selectExpr("1L as page_id", "url").unionAll(spark.range(3000).selectExpr("2L", "concat('https://o', id, '.org/x')"))
    got = urls.judge_urls(pages, listed, [], scratch).groupBy("page_id").agg({"possible": "count"}).collect()
    rows = urls.judge_urls(pages, listed, [], scratch).collect()
    assert len(got) == 2 and all(r.listed and r.verdict == "block" for r in rows if r.page_id == 1)
    assert sum(r.possible for r in rows if r.page_id == 2) < 150 and not any(r.listed for r in rows if r.page_id == 2)
    ordinary = spark.createDataFrame([(1, "https://news.site.org/a/1/"), (2, "https://news.site.org/a/2"), (3, "https://cheap-pills.org/x"), (4, "http://www.news.site.org/a/1?page=2")], "page_id long, url string")
    few = spark.createDataFrame([("https://news.site.org/a/1",)], "url string")
    # no word of a host decides: one page of an ordinary site is listed, a site with a telling name is not
    assert {r.page_id: r.verdict for r in urls.judge_urls(ordinary, few, [], scratch).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}
    none = spark.createDataFrame([], "url string")
    assert not any(r.possible for r in urls.judge_urls(pages, none, [], scratch).collect())
    assert urls.n_blocks_for(0) == 1 and urls.n_blocks_for(10**12) == urls.MAX_BLOCKS
    assert urls.judge_urls(pages.limit(0), listed, URL_RULES, scratch).collect() == []
