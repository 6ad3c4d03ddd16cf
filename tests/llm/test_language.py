"""Kneser-Ney models against a plain version, and odd rows of the language operator."""

import collections
import math
import random

import pytest

from loglathe.llm import language


def plain_losses(counts, word):
    """Negative log likelihood of a word by dictionaries of strings."""
    edge, order = "\x01", language.ORDER
    grams = collections.Counter()
    for w, c in counts.items():
        s = edge * (order - 1) + w.decode() + edge
        for end in range(order - 1, len(s)):
            grams[s[end - order + 1 : end + 1]] += c
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    tables = {}
    for k, table in levels.items():
        n1, n2 = (sum(c == n for c in table.values()) for n in (1, 2))
        total, kinds = collections.Counter(), collections.Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables[k] = table, total, kinds, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    s, loss = edge * (order - 1) + word + edge, 0.0
    for end in range(order - 1, len(s)):
        p = 1e-5
        for k in range(1, order + 1):
            table, total, kinds, discount = tables[k]
            g = s[end - k + 1 : end + 1]
            if total[g[:-1]]:
                p = max(table[g] - discount, 0) / total[g[:-1]] + discount * kinds[g[:-1]] / total[g[:-1]] * p
        loss -= math.log(p)
    return loss


def test_models_against_a_plain_version():
    r = random.Random(6)
    counts = {g: collections.Counter("".join(r.choices(letters, k=r.randrange(1, 7))).encode() for _ in range(300)) for g, letters in (("aa", "abcde"), ("bb", "cdeéß"))}
    models = language.fit(counts)
    words = ["a", "abc", "ßé", "edcbaabcde", "zzz", "caé"]
    losses, lengths = models.words([w.encode() for w in words])
    assert lengths.tolist() == [len(w) + 1 for w in words]
    for w, found in zip(words, losses, strict=True):
        assert found.tolist() == pytest.approx([plain_losses(counts[g], w) for g in models.languages], rel=1e-9)


def test_odd_rows_and_calibration(spark):
    r = random.Random(12)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ver"]}
    text = lambda g, n=30: " ".join("".join(r.choices(parts[g], k=3)) for _ in range(n))
    rows = [(i, text(g), g) for i, g in enumerate(list(parts) * 120)]
    rows += [(800, text("bb", 60_000), None), (801, None, "aa"), (802, "", None), (803, "12 !", "bb"), (804, "qxzw yyqx " * 20, None), (None, text("aa"), None), rows[3]]
    docs = spark.createDataFrame([(*x, "c", 1.0, True) for x in rows], "doc_id long, text string, lang string, word string, score double, aside boolean").repartition(3)
    out = language.identified(docs, language.train(docs)).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    assert got[800].lang_pred == "bb" and not got[800].rejected
    assert got[None].lang_pred == "aa" and got[804].rejected
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (801, 802, 803))
    assert sum(x.rejected for x in out if x.doc_id is not None and x.doc_id < 240) <= 5
    assert len({(x.lang_pred, x.score) for x in out if x.doc_id == 3}) == 1
    assert language.identified(docs.limit(0), language.train(docs)).count() == 0


def test_long_words_are_not_kept(monkeypatch):
    models = language.fit({"a": collections.Counter({b"abab": 3, b"aba": 1}), "b": collections.Counter({b"xyxy": 2})})
    words = [b"abab", b"x" * 5000, b"aba", b"xy"]
    whole = language.Scorer(models).entropies([words, []])
    monkeypatch.setattr(language, "MOST_BYTES", 100)
    monkeypatch.setattr(language, "SLICE_BYTES", 4)
    scorer = language.Scorer(models)
    for _ in range(2):
        again = scorer.entropies([words, []])
        assert again[0].tolist() == pytest.approx(whole[0].tolist()) and again[1] is None
        assert not scorer.known and not len(scorer.table)
