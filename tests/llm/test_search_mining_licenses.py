"""Lexical search, collocations and license scan against plain loops and SQL on small tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.conftest import DOC, sentence
from tests.llm.test_operators import rows, same_with_clashes
from tests.oracle import compare
from trackframe.llm import collocations, lexical, licenses, sqltwins

ITEM = "item_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOW)


def sql_over(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con


# 11. lexical search


def ranked(docs, items, top=20):
    """[(item, rank, doc, score)] by the rule of the contract, one row of docs after the other."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall(low(t)))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    N, L, df = sum(n > 0 for n in lengths), sum(lengths), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, bag), n in zip(bags, lengths):
            m = 75 + (25 * n * N) // L if L else 0
            s = sum(math.floor(1000 * math.log((2.0 * N + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in term.findall(low(text)) if bag[t])
            scores += [(-s, doc is None, doc)] if s > 0 else []
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def items(spark, odd_rows):
    base = odd_rows[0][1].split()
    texts = [(1, " ".join(base[3:30])), (2, "ONE one two"), (3, ""), (4, None), (5, " ".join(base[:4]) + ", " + odd_rows[9][1][:200]), (None, "one"), (6, "é¿ _123_")]
    return texts, spark.createDataFrame(texts, ITEM)


def test_search_equals_brute_force(odd, odd_rows, clash, none, items):
    listed, table = items
    want = ranked([(r[0], r[1]) for r in odd_rows], listed)
    for block in (lexical.BLOCK_BYTES, 60):
        got = same_with_clashes(lambda d: lexical.search(d, table, block_bytes=block), odd, clash, "item_id", "rank", "doc_id", "score")
        assert got == sorted(want, key=repr)
    assert lexical.search(none, table).count() == 0 and lexical.search(odd, table.limit(0)).count() == 0
    assert rows(lexical.search(odd, table.union(table)), "item_id", "rank", "doc_id", "score") == got


def test_search_equals_sql_and_ties_go_by_id(spark, odd, items):
    docs = odd.unionByName(spark.createDataFrame([(5000 - i, f"same words here {'x' if i % 3 else 'one'}", None, None, None) for i in range(60)] + [(None, "same words one", None, None, None)], DOC))
    table = items[1].where("item_id is not null").unionByName(spark.createDataFrame([(77, "words same"), (78, "here x")], ITEM))
    with_id = docs.where("doc_id is not null")
    assert compare(lexical.search(with_id, table), sqltwins.SEARCH, sql_over(documents=with_id, benchmark=table))[1] is None
    assert rows(lexical.search(docs, table), "item_id", "rank", "doc_id", "score") == sorted(ranked([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in table.collect()]), key=repr)


def test_best_keeps_ties_across_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    score, doc = rng.integers(0, 4, (500, 3)), rng.permutation(500)
    best = lexical.Best(3, 7)
    for lo in range(0, 500, 33):
        best.add(score[lo : lo + 33], doc[lo : lo + 33])
    for i in range(3):
        want = sorted((-s, d) for s, d in zip(score[:, i].tolist(), doc.tolist()) if s > 0)[:7]
        assert [(-s, d) for k, s, d in zip(best.item.tolist(), best.score.tolist(), best.doc.tolist()) if k == i] == want


# 12. collocations


def mined(docs, least, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) from (text, lang) pairs."""
    total, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", low(text)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        got = []
        for p, a in cands.items():
            if longer[p] and 100 * longer[p] >= 80 * a:
                continue
            s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            got.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(got)[:top], 1)]
    return out


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def prose(rng, n):
    return "".join(rng.choice(["the", "of", "a", "New", "york", "big\tapple", "é", "x-y", "Z"]) + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    data = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["en", "de", None]), "s", 0) for i in range(150)]
    data += [(i, t, la, "s", 0) for i, t, la in [(900, None, "en"), (901, "", None), (902, "new york " * 3000, "en"), (903, "a.b.c", "zz"), (904, "new", "en")]]
    return data + data[:9], spark.createDataFrame(data + data[:9], DOC)


def test_collocations_equal_brute_force(monkeypatch, mixed, odd, clash, none):
    data, docs = mixed
    for least, chunk, share in ((30, 1_000_000, 1000), (2, 100, 4)):
        monkeypatch.setattr(collocations, "HOT_SHARE", share)
        want = mined([(r[1], r[2]) for r in data], least)
        assert rows(collocations.collocations(docs, least, chunk_words=chunk), *COLUMNS) == sorted(want, key=repr)
    assert any(" " in w[2] for w in want) and {w[0] for w in want} >= {"en", "und"}
    same_with_clashes(lambda d: collocations.collocations(d, 2), odd, clash, *COLUMNS)
    assert collocations.collocations(none).count() == 0


def test_collocations_equal_sql_and_top(mixed):
    data, docs = mixed
    assert compare(collocations.collocations(docs), sqltwins.PHRASES, sql_over(documents=docs))[1] is None
    want = mined([(r[1], r[2]) for r in data], 2, 10)
    assert rows(collocations.collocations(docs, 2, top=10), *COLUMNS) == sorted(want, key=repr)


# 13. license scan

SCAN = sqltwins.licenses(licenses.PHRASES, licenses.TEMPLATES, licenses.RARE, licenses.SLACK, licenses.AGREE)
LICENSE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
MIT = licenses.TEMPLATES[1][1]


@pytest.fixture(scope="module")
def files(spark, odd_rows):
    rng = random.Random(9)
    broken = MIT.split()
    del broken[20:24]
    data = [
        (1000, MIT), (1001, sentence(rng, 300) + "\n# " + MIT.replace(" ", "\n# ") + sentence(rng, 50)), (1002, " ".join(broken)), (1003, MIT.replace("without restriction", "with some restriction")),
        (1004, "cc by cc by-nc CC  BY MIT\tLicense gnu general public licenses"), (1005, "Licensed under CC BY-NC 4.0."), (1006, "the apache license"), (1007, "license " * 4000),
        (1008, licenses.TEMPLATES[3][1] + " " + licenses.TEMPLATES[9][1]), (1009, " ".join(rng.sample(MIT.split(), len(MIT.split())))), (1010, "GNU general public licence"), (None, "MIT License"), (1011, "gnu general"),
    ]
    return spark.createDataFrame([(r[0], r[1], None, None, None) for r in data] + odd_rows, DOC)


def test_licenses_found(files):
    got = {r.doc_id: r for r in licenses.find_licenses(files).collect()}
    assert len(got) < files.count() == licenses.find_licenses(files).count()
    assert [got[i].labels for i in (1000, 1001, 1002, 1003)] == ["mit", "mit", "mit", ""] and got[1000].base_labels == "" and got[1000].score == 1
    assert (got[1004].n_base, got[1004].first_word, got[1004].last_word, got[1004].base_labels) == (4, 0, 7, "cc-by,mit")
    assert (got[1005].base_labels, got[1005].labels) == ("cc-by", "cc-by,cc-by-nc") and got[1008].labels == "apache,bsd"
    assert (got[1006].labels, got[1006].score) == ("apache", 0.5) and got[None].labels == "mit"
    assert [got[i].labels for i in (1007, 1009, 1010, 1011)] == [""] * 4
    assert (got[2].n_words, got[2].first_word, got[2].score, got[2].labels) == (0, None, 0, "") and got[10].labels == ""


def test_licenses_equal_sql(files, odd, clash, none):
    assert compare(licenses.find_licenses(files), SCAN, sql_over(documents=files))[1] is None
    same_with_clashes(licenses.find_licenses, odd, clash, *LICENSE)
    assert licenses.find_licenses(none).count() == 0


def test_license_scan_uses_no_python(files):
    plan = licenses.find_licenses(files)._jdf.queryExecution().toString()
    assert not re.search(r"MapInArrow|MapInPandas|PythonUDF|ArrowEval|BatchEval", plan)
