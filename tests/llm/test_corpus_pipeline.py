"""Stages of the pipeline against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tabulith.llm import resemblance

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) if a or b else True


def rows_of_near_copies():
    """(doc_id, text): copies with words exchanged to similarities around 0.8, chains, copies, repeated and missing ids, no words."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(40, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
    out += [out[0], out[0].upper(), out[3], None, "", " \t", "one two", "ONE  two", "one two three"]
    ids = list(range(1, len(out) + 1))
    rng.shuffle(ids)
    rows = list(zip(ids, out, strict=True))
    return [*rows, (rows[0][0], "another text under an id that is taken already"), (rows[1][0], rows[1][1]), (None, rows[0][1]), (None, None)]


def kept_of(rows):
    sets = [shingled(t) for _, t in rows]
    left = {k for k, (i, _) in enumerate(rows) if i is not None}
    out = [rows[k] for k in range(len(rows)) if k not in left]
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            group.add(x := queue.pop())
            near = {k for k in left if similar(sets[x], sets[k])}
            left -= near
            queue += near
        least = min(rows[k][0] for k in group)
        out.append((least, {rows[k][1] for k in group if rows[k][0] == least}))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], DOC)


def test_near_dedup(spark, sf_dir):
    rows = rows_of_near_copies()
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs_of(spark, rows), sf_dir).collect())
    want = sorted(((i or 0, t) for i, t in kept_of(rows)), key=lambda x: (x[0], str(x[1])))
    assert len(got) == len(want) < len(rows) - 60
    open_ = list(want)
    for i, t in got:
        open_.remove(next(w for w in open_ if w[0] == i and (t in {x or "" for x in w[1]} if isinstance(w[1], set) else t == (w[1] or ""))))
    assert not open_
    assert corpus_pipeline.near_dedup(spark, docs_of(spark, rows).limit(0), sf_dir).count() == 0


def test_simhash_links_candidates_of_near_dedup(spark, sf_dir, monkeypatch):
    """Without any band, near copies within four bits still meet; what is further apart and texts without words are not linked by it."""
    monkeypatch.setattr(resemblance, "candidates", lambda sets: sets.sparkSession.createDataFrame([], "u long, v long"))
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    texts = [base, [*base[:-1], "other"], base + base[:4], [f"v{rng.randrange(3000)}" for _ in range(300)], [], ["other"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts, 1)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(spark, rows), sf_dir).collect()) == [1, 4, 5, 6]


@pytest.mark.parametrize("shared", [88, 89])
def test_similarity_is_exact(shared):
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate((a[:shared], np.arange(1000, 1100 - shared, dtype=np.uint64)))
    assert len(set(resemblance.grown([a, b]).tolist())) == (1 if shared == 89 else 2)


def cut(docs):
    """The words that are left of each (doc_id, text): windows of 50 that a smaller doc_id has are gone."""
    words = {i: (t or "").split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s : s + 50]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for s in range(len(ws) - 49):
            if first[tuple(ws[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        out[i] = [w for k, w in enumerate(ws) if k not in gone], len(gone)
    return out


def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that the operators name too."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, "the house and the sea", "en", "s", 5), (1, "the house and the sea", "en", "s", 5), (None, None, None, None, None), (2, None, "en", None, 0), (3, "", None, "s", None), (4, long, "en", "s", 1), (None, "of the and", "en", "s", 9), (5, "12 % !?", "en", "s", 7)]
    return spark.createDataFrame([(*r, 1, 0.5, "b", 2, "x") for r in rows], DOC + ", n_words int, score double, bucket string, rank int, mark string")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_table(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd_rows(spark)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    out = stage(spark, docs, sf_dir)
    if name == "best_fit_packing":
        got = out.collect()
        assert sum(r.length for r in got if r.doc_id == 4) > 60_000 and all(len(r.ids) == 4 * r.length for r in got)
        assert sorted({(r.doc_id or 0) for r in got}) == [0, 1, 2, 3, 4, 5]
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    ids = sorted(((r.doc_id or 0), len(r.text or "")) for r in out.collect())
    every = sorted(((r.doc_id or 0), len(r.text or "")) for r in docs.collect())
    if name == "language_id":  # no letter, no language
        assert ids == [x for x in every if x[1] and x[0] != 5]
    elif name == "near_dedup":  # one of the copies, one of the texts without words; those without an id stay
        assert len(ids) == len(every) - 2 and [x for x in ids if x[0] == 0] == [x for x in every if x[0] == 0]
    else:
        assert [i for i, _ in ids] == [i for i, _ in every]
    assert {(r.n_words, r.score, r.bucket, r.rank, r.mark) for r in out.collect()} == {(1, 0.5, "b", 2, "x")}
    assert stage(spark, docs.drop("n_chars"), sf_dir).columns == docs.drop("n_chars").columns


def test_run(spark, tmp_path):
    """All stages; no row has a lang, so no language can be told and none is rejected."""
    from tokenizers import Tokenizer

    from tabulith.llm import tokens

    encode = Tokenizer.from_file(tokens.tokenizer_path()).encode
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = draw(70), draw(200)
    texts = [base, [*base[:-2], "other", "end"], *[[*draw(90), *passage, *draw(60)] for _ in range(4)], draw(1500), draw(9), base]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, next(iter(t))) for i, t in kept_of(rows)]
    want = cut(kept)
    assert sorted(want) == [1, 3, 4, 5, 6, 7, 8] and [want[i][1] > 0 for i in (3, 4, 5, 6)] == [False, True, True, True]
    stage = corpus_pipeline.substring_dedup(spark, docs_of(spark, kept), str(tmp_path)).collect()
    assert {r.doc_id: r.text.split() for r in stage} == {i: w for i, (w, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in stage)
    pieces = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert pieces == {r.doc_id: [*encode(r.text, add_special_tokens=False).ids, 2] for r in stage}
