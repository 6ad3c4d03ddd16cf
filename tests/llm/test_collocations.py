"""Phrase collocations against counts of all phrases."""

import collections
import random
import re

import pytest
from loglathe.llm import collocations

SCHEMA = "doc_id long, text string, lang string, f long, n long, word string"


def corpus(seed=3, n=160):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(25)] + ["Été", "THE", "the", "of"]
    passage = " ".join("p%d" % i for i in range(40))
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2:
            texts.append(f"{r.choice(words)} {passage}. {r.choice(words)}")
        elif kind < 0.4:
            texts.append(" ".join(["of the " + r.choice(words) for _ in range(r.randrange(1, 20))]))
        else:
            texts.append("".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ", ", "\n", "\x0b"]) for _ in range(r.randrange(1, 80))))
    texts += [None, "", " .!? ", "one", "x" * 30_000, "a " * 3000, "b b b b. " * 40, "ring one two three four " * 30]
    rows = [(i, t, r.choice(["en", "en", "fr", None]), 1, 2, "clash") for i, t in enumerate(texts)]
    return rows + rows[:30]


def plain(rows, top=2000):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def result(docs, **more):
    return set(map(tuple, collocations.collocations(docs, **more).collect()))


def test_against_all_phrases(docs, rows):
    want = plain(rows)
    assert len(want) > 100
    assert result(docs) == want
    assert result(docs, top=7) == plain(rows, 7)


def test_hot_nodes_are_dealt_over_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_EDGES", 40)
    texts = docs.selectExpr("coalesce(lang, 'und') AS lang", "CAST(coalesce(text, '') AS BINARY) AS text")
    hot = collocations.hot_nodes(texts, 10_000, 0)
    assert sum(len(nodes) for nodes, _ in hot.values()) > 20 and max(int(m.max()) for _, m in hot.values()) > 5
    assert result(docs) == plain(rows)


def test_cut_paths(docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "PATH_EDGES", 3)
    assert result(docs) == plain(rows)


def test_paths_are_unary(docs, monkeypatch):
    flows = collocations.counted(docs)
    found = collocations.paths(flows).collect()
    assert max(len(r.edges) for r in found) >= 36  # the passage
    assert sum(len(r.edges) for r in found) == flows.where("kind = 'edge'").count()
    ends = collections.Counter()
    for r in found:
        for before, after in zip(r.edges, r.edges[1:]):
            assert (before.w2, before.w3) == (after.w1, after.w2) and before.head_f == after.tail_f
            ends[r.lang, after.w1, after.w2] += 1
    assert set(ends.values()) == {1}


def test_equal_hashes_of_two_words_are_found(docs, rows, spark, monkeypatch):
    flows = collocations.counted(docs)
    plain_hashes = collocations._hashes
    monkeypatch.setattr(collocations, "_hashes", lambda words, seed: plain_hashes(words, seed) // (1 if seed else 1 << 60))
    seen = list(collocations._counted(1, {}, 0)(iter(docs.selectExpr("coalesce(lang, 'und') AS lang", "CAST(coalesce(text, '') AS BINARY) AS text").toArrow().to_batches())))
    import pyarrow as pa

    words = pa.Table.from_batches(seen).filter(pa.compute.less(pa.compute.field("bucket"), 0))
    out = collocations._word_flows("en", words.filter(pa.compute.field("lang") == "en"))
    assert "clash" in out.column("kind").to_pylist() and not flows.where("kind = 'clash'").count()


def test_no_phrases(spark, docs):
    assert result(docs.limit(0)) == set()
    assert result(spark.createDataFrame([(1, "just a few words", "en", 1, 1, "")], SCHEMA)) == set()


def test_products_beyond_64_bits():
    a = 3_000_000_000_000
    assert collocations.best_cut(a, [(a, a + 1), (a + 1, a)]) == (1_000_000 * a * a // (a * (a + 1)), a, a + 1)
