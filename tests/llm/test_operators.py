"""The training-data operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from loglathe.llm import bpe, chat, components, jaccard, language, media, mixing, quality, substring, toxicity, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kd string, n_words int"


def corpus(seed=1, n=120):
    """Random texts with copies, near copies, shared passages, nulls, ties and clashing columns."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["Été", "ñandú", "THE", "the"]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.35 and texts:
            w = (r.choice(texts) or "").split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.5:
            texts.append(" ".join([*r.choices(words, k=r.randrange(30)), passage, *r.choices(words, k=r.randrange(30))]))
        else:
            texts.append(r.choice([" ", "\n"]).join(r.choices(words, k=r.randrange(1, 120))))
    texts += [None, "", "  \n", "one two", "one two", "x" * 50_000, "a " * 3000]
    rows = [(i * 3, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", None]), len(t or ""), "clash", 7) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[5]] + [(None, "no id here at all", None, None, 3, "clash", 7)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    """Distinct documents in their order: by id, null last."""
    seen = {(2**63 - 1 if i is None else i, t) for i, t, *_ in rows}
    return sorted(seen, key=lambda x: (x[0], x[1] or ""))


def test_media_round_trip(docs, rows, empty):
    want = {t: media.pad((t or "").encode()) for _, t, *_ in rows}
    got = media.describe(media.store(docs)).collect()
    assert len(got) == len(rows)
    by_sha = collections.Counter((r.payload_sha256, r.payload_bytes, r.tail_crc32) for r in got)
    assert by_sha == collections.Counter((hashlib.sha256(want[t]).hexdigest(), len(want[t]), zlib.crc32(want[t][-16:])) for _, t, *_ in rows)
    assert media.describe(media.store(empty)).count() == 0


def test_media_all_bytes():
    payloads = [bytes(range(256)) * 3, b"\xff" * 192, b"\0" * 384]
    assert [media.payload_of(*x) for x in media.decode(media.encode(payloads))] == payloads
    image, c = media.decode(media.encode(payloads[:1]))[0]
    assert media.thumbnail(image, c).shape == (image.height // 8, image.width // 8)
    with pytest.raises(ValueError, match="SOI"):
        media.parse(b"no image")


def test_substring_against_brute_force(docs, rows, empty):
    seen, want = set(), {}
    for i, t in ordered(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        want[i, t] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), sum(gone)
    got = substring.deduplicated(docs)
    assert got.columns == docs.columns
    out = collections.Counter((r.doc_id, r.text if r.text is None else " ".join(r.text.encode().split() and [b" ".join(r.text.encode().split()).decode()])) for r in got.collect())
    assert out == collections.Counter((i, None if t is None else want[2**63 - 1 if i is None else i, t][0]) for i, t, *_ in rows)
    assert substring.deduplicated(empty).count() == 0


def test_substring_hot_anchors(docs, rows, monkeypatch):
    plain = sorted(map(repr, substring.deduplicated(docs).collect()))
    monkeypatch.setattr(substring, "HOT", 3)
    assert sorted(map(repr, substring.deduplicated(docs).collect())) == plain


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_against_brute_force(docs, rows, empty):
    d = ordered(rows)
    sets = [shingle_set(t) for _, t in d]
    parent = list(range(len(d)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(d)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = collections.Counter()
    at = {x: i for i, x in enumerate(d)}
    for i, t, *_ in rows:
        k = at[2**63 - 1 if i is None else i, t]
        first = d[root(k)][0]
        want[i, len(sets[k]), i if not sets[k] or first == 2**63 - 1 else first] += 1
    got = jaccard.classes(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    stay = jaccard.first_of_each(docs)
    assert stay.columns == docs.columns
    assert stay.count() == len({root(i) for i in range(len(d)) if sets[i]}) + sum(not s for s in sets)
    assert jaccard.classes(empty).count() == 0


def test_components_and_later_edges(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    table = lambda rows: spark.createDataFrame(rows, "u long, v long")
    got = components.joined(components.components(table(edges[:150])), table(edges[150:])).collect()
    assert len(got) == len(root) and {x.u: x.label for x in got} == {x: find(x) for x in root}
    assert components.components(table([])).count() == 0


def test_bpe_against_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encoded(docs).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.digests(empty).count() == 0


def test_bpe_words():
    from tokenizers import Tokenizer

    tok, own, r = Tokenizer.from_file(bpe.default_path()), bpe.Automaton(*bpe.load(bpe.default_path())), random.Random(3)
    texts = ["".join(r.choices("abcdehilnorst", k=r.randrange(1, 30))) for _ in range(3000)] + ["aaaaaaa aaaa", "İΣ σς", "<|endoftext|>x", "it's we'll", "日本 🙂🙂", "z" * 3000]
    assert [own.encode(t) for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_longest_match_counts():
    r = random.Random(5)
    words = {tuple(r.choices(range(3), k=r.randrange(1, 6))) for _ in range(40)} | {(i,) for i in range(3)}
    own = wordpiece.LongestMatch(words)
    for _ in range(500):
        s, n, at = r.choices(range(4), k=r.randrange(1, 25)), 0, 0
        while at < len(s):
            ends = [j for j in range(len(s), at, -1) if tuple(s[at:j]) in words]
            if not ends:
                n = 1
                break
            at, n = ends[0], n + 1
        assert own.count(s) == n


def test_quality_measures(docs, rows, empty):
    assert quality.text_measures(b"a b c d e x a b c d e\na b c d e x a b c d e\n\n#$")[:5] == (23, 24, 2, 1, 22)
    assert quality.text_measures(b"") == (0, 0, 0, 0, 0, 0)
    judged = quality.judge(docs).collect()
    assert len(judged) == len(rows) and all(not r.kept for r in judged if r.base_failed)
    assert quality.kept_rows(docs).columns == docs.columns
    assert quality.kept_rows(docs).count() == sum(r.kept for r in judged)
    assert quality.judge(empty).count() == 0


def test_mixing_meets_targets(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    total = sum(r.size for r in got)
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6 * total
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= len(rs) + 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_toxicity_learns_words(spark):
    r = random.Random(7)
    clean = ["w%d" % i for i in range(200)]
    rows = []
    for i in range(1500):
        w = r.choices(clean, k=30)
        toxic = i % 7 == 0
        if toxic:
            w[r.randrange(30)] = r.choice(["vile", "rotten", "gruntx" + r.choice("abcdefgh")])
        rows.append((i, " ".join(w), int(toxic)))
    d = spark.createDataFrame([*rows, (9999, None, 0)], "doc_id long, text string, toxic int")
    labels = d.select("doc_id", "toxic")
    out = toxicity.scored(d, toxicity.train(d, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(d, toxicity.train(d, labels.limit(0))).where("predicted = 1").count() == 0


def test_language(spark):
    r = random.Random(9)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "tion", "ch", "ré"]}
    rows = [(i, " ".join("".join(r.choices(parts[g], k=3)) for _ in range(20)), g) for i, g in enumerate(list(parts) * 100)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !?", "aa")], "doc_id long, text string, lang string")
    out = language.identified(d, language.train(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in out if r.doc_id < 900]) > 0.99
    assert {r.lang_pred for r in out if r.doc_id >= 900} == {"und"}
    assert language.identified(d, language.train(d.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_chat_keeps_maximal(spark, monkeypatch):
    turns = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "a", "x") + turns(5, "a") + turns(6, None) + turns(7, "") + [(2, 0, "user", "a")] + [(None, 0, "user", "z")]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for block in (512, 2):
        monkeypatch.setattr(chat, "BLOCK", block)
        got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.formatted(d).collect()}
        assert set(got) == {2, 4, 6, 7, None}
        assert got[2] == (3, 2, "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n")
    assert chat.formatted(d.limit(0)).count() == 0
