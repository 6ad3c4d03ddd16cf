"""The pipeline against a plain version of its five stages, and the operators' SQL against DuckDB."""

import collections
import hashlib
import math

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loglathe.llm import bpe, chat, mixing, oracles, quality, queries, wordpiece

from test_operators import SCHEMA, corpus, ordered, shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = corpus(seed=21, n=160)
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_words", "m").coalesce(2).write.parquet(str(path / "documents.parquet"))
    turns = [(c % 9 + 1, t, "user" if t % 2 == 0 else "assistant", f"say {t if c % 3 else min(t, c % 2)}") for c in range(30) for t in range(1 + c % 5)]
    spark.createDataFrame([*turns, turns[4]], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(path / "conversations.parquet"))
    return path, rows


def sql(path, text):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    rel = con.sql(text)
    return rel.columns, rel.fetchall()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, folder, name):
    names, want = sql(folder[0], queries.oracle_sql()[name])
    got = queries.queries()[name](spark, str(folder[0])).select(*names).collect()
    assert collections.Counter(tuple(map(plain, r)) for r in got) == collections.Counter(tuple(map(plain, r)) for r in want)


def words(text):
    return (text or "").encode().split()


def one_of_each(rows):
    left = [r for r in ordered(rows)]
    sets = [shingle_set(t) for _, t in left]
    label = list(range(len(left)))
    for _ in left:  # spread the least label until nothing changes
        before = list(label)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(a & b)
                if both and 100 * both >= 80 * (len(a) + len(b) - both):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return [d for i, d in enumerate(left) if label[i] == i]


def without_passages(docs):
    seen, out = set(), []
    for key, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            window = tuple(w[a : a + 20])
            if window in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(window)
        out.append((key, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else text))
    return out


def water_filled(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        target |= {s: float(3 * sizes[s]) for s in over}
        free -= over
        left -= sum(3 * sizes[s] for s in over)


def drawn(key):
    digits = hashlib.md5(f"{mixing.SEED}:{'' if key == 2**63 - 1 else key}".encode()).hexdigest()
    return int(digits[:8], 16) % mixing.SLICES, int(digits[8:16], 16) % 1_000_000


def times_taken(docs, source):
    by = collections.defaultdict(list)
    for key, text in docs:
        by[source[key]].append((*drawn(key), key, len(words(text))))
    target = water_filled({s: sum(n for *_, n in rows) for s, rows in by.items()})
    out = {}
    for s, rows in by.items():
        size = sum(n for *_, n in rows)
        whole = math.floor(target[s] / size) if size else 0
        more, before, cut = target[s] - whole * size, 0, None
        slices = collections.Counter()
        for at, _, _, n in rows:
            slices[at] += n
        for at in sorted(slices):
            if before <= more:
                cut, part = at, min(1.0, (more - before) / slices[at]) if slices[at] else 0.0
            before += slices[at]
        for at, offset, key, _ in rows:
            out[key] = whole + (at < cut or (at == cut and offset < 1_000_000 * part))
    return out


def test_pipeline_against_a_plain_version(spark, folder):
    path, rows = folder
    names, verdicts = sql(path, oracles.op4_sql())
    kept = {r[names.index("doc_id")] for r in verdicts if r[names.index("kept")]}
    docs = without_passages(one_of_each([r for r in rows if r[0] in kept]))
    source = {2**63 - 1 if r[0] is None else r[0]: r[3] for r in rows}
    times = times_taken(docs, source)
    tok, want = Tokenizer.from_file(bpe.default_path()), collections.Counter()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, text in docs:
        ids = tok.encode(text, add_special_tokens=False).ids
        if times[key]:
            want[None if key == 2**63 - 1 else key, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += times[key]
    got = corpus_pipeline.run(spark, str(path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(want) > 20 and collections.Counter(map(tuple, got)) == want


def test_stages_take_empty_and_clashing_tables(spark, folder):
    docs = spark.createDataFrame(folder[1], SCHEMA)
    clashing = docs.withColumnsRenamed({"kd": "row", "n_words": "m"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        assert stage(spark, clashing, "").columns == clashing.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_token_counts_of_the_query(spark, folder):
    path, rows = folder
    tokens, _, suffix, special = bpe.load(bpe.default_path())
    labels = set(wordpiece.vocabulary(tokens, suffix, special))

    def count(word):
        symbols = (*word[:-1], word[-1] + 256)
        at = n = 0
        while at < len(symbols):
            end = next((e for e in range(min(len(symbols), at + 40), at, -1) if symbols[at:e] in labels), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    want = collections.Counter()
    for i, t, *_ in rows:
        counts = [count(w) for w in (t or "").encode().lower().split()]
        want[i, len(counts), sum(counts), max(counts, default=0)] += 1
    got = wordpiece.op6_token_counts(spark, str(path))
    assert collections.Counter(map(tuple, got.collect())) == want
    assert wordpiece.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_and_chats_of_empty_tables(spark):
    assert quality.kept_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn int, role string, text string, h1 int, pos int")).count() == 0
