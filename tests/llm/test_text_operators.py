"""Text operators against plain Python, with the awkward cases of each."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulith.llm import _words, htmltext, langid, licences, packing, simhash, substrings, tokens, trie_bpe, wrappers

DOC = "doc_id long, text string, lang string, n_words long, score double"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


def texts():
    """Copies, shared passages, long, empty and null texts, repeated words and odd white space."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 260))) for _ in range(24)]
    out = [*base, *base[:6], *[f"{b} {passage}\n{b[:30]}" for b in base[6:12]], "the " * 300, "the " * 120, " ".join(base), None, "", "  \t ", "one", "Ünïcode space　x\0y " * 30, base[3].upper(), base[4] + " changed"]
    return [(k + 1, t) for k, t in enumerate(out)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "xx", 7, 0.5) for i, t in rows], DOC)


def test_substrings(spark):
    rows = texts()
    words = {i: (t or "").encode().split() for i, t in rows}
    first: dict[tuple, int] = {}
    for i, ws in words.items():
        for s in range(len(ws) - 49):
            first.setdefault(tuple(ws[s : s + 50]), i)
    want = {}
    for i, ws in words.items():
        gone = [False] * len(ws)
        for s in range(len(ws) - 49):
            if first[tuple(ws[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        want[i] = len(ws), sum(gone), hashlib.sha256(kept).hexdigest()
    docs = documents(spark, rows)
    got = substrings.dedup(docs, joined=True)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()} == want
    assert sum(n for _, n, _ in want.values()) > 1000
    cut = {r.doc_id: r for r in substrings.dedup(docs).collect()}
    for i, t in rows:
        assert cut[i].lang == "xx" and (cut[i].text == t or want[i][1])
        assert hashlib.sha256(b" ".join((cut[i].text or "").encode().split())).hexdigest() == want[i][2]


def test_substrings_of_repeated_and_nameless_rows(spark):
    long = " ".join(f"a{i}" for i in range(80))
    rows = [(1, long), (1, long), (None, long), (2, long)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup(documents(spark, rows), joined=True).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 80)]
    assert substrings.dedup(documents(spark, []).limit(0)).count() == 0


def test_windows_that_collide_in_one_hash(spark):
    """Thue-Morse words collide modulo 2**64 under any odd base: the windows differ in their last word alone."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    start = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{start} {word}"), (2, f"{start} {word.translate(str.maketrans('ab', 'ba'))}"), (3, f"{start} {word}")]
    got = {r.doc_id: r.n_removed for r in substrings.dedup(documents(spark, rows), joined=True).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_values_of_windows_are_those_of_polynomials():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(60)).encode()
    texts = _words.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    base, words = 987654321987654321, text.split()
    want = []
    for at in range(56):
        total, e = 0, 0
        for w in words[at : at + 5]:
            for c in w:
                total += (c + 1) * pow(base, e, _words.P61)
                e += 1
            e += 1
        want.append(total % _words.P61)
    for block in (1 << 22, 7):
        assert _words.windows61(texts, np.arange(56), 5, base, block).tolist() == want


def test_substrings_in_many_buckets_and_stretches(spark, monkeypatch):
    """A hot passage in every document, negative and large ids, a text beyond a slice."""
    rng = random.Random(12)
    words = [f"v{i}" for i in range(3000)]
    hot = [rng.choice(words) for _ in range(80)]
    rows = [(rng.choice([-1, 1]) * (k + 1) * 10**rng.randint(0, 12), " ".join([rng.choice(words) for _ in range(rng.randint(0, 90))] + hot[: rng.randint(40, 80)])) for k in range(60)]
    rows.append((-(10**15), " ".join([*(rng.choice(words) for _ in range(500_000)), *hot])))
    seen, want = {}, {}
    split = {i: t.split() for i, t in rows}
    for i in sorted(split):
        for s in range(len(split[i]) - 49):
            seen.setdefault(tuple(split[i][s : s + 50]), i)
    for i, ws in split.items():
        gone = set()
        for s in range(len(ws) - 49):
            if seen[tuple(ws[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        want[i] = len(gone)
    got = {r.doc_id: r.n_removed for r in substrings.dedup(documents(spark, rows)).select("doc_id", "n_removed").collect()}
    assert got == want and sum(v > 0 for v in want.values()) > 30


def fingerprint(text, n=4):
    ws = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + n]), 42) for k in range(max(1, len(ws) - n + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_of(prints):
    above = {i: i for i in prints}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark):
    rows = texts()
    prints = {i: fingerprint(t) for i, t in rows}
    got = simhash.near_duplicates(documents(spark, rows)).select("doc_id", simhash.hexadecimal().alias("h"), "component_id").collect()
    comps = components_of(prints)
    assert {r.doc_id: (r.h, r.component_id) for r in got} == {i: (format(prints[i], "016x"), comps[i]) for i in prints}


def test_links_of_near_fingerprints(spark):
    """Chains and dense groups around one fingerprint: the forest has the components of all links."""
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center} | {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for blocks in (simhash.NARROW, simhash.WIDE):
        forest_of(fps, [(r.u % 2**64, r.v % 2**64) for r in simhash.links(df, blocks=blocks).collect()])


def test_links_are_found_at_every_place_of_their_bits():
    """For each pair of fingerprints that differ in up to 4 bits some anchor holds both, one of them at home."""
    rng = random.Random(13)
    for blocks in (simhash.NARROW, simhash.WIDE):
        for _ in range(60):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 4)))
            fps = np.array([a, b], np.uint64)
            got = [np.concatenate(x) for x in zip(*simhash.anchors(fps, 4, blocks), strict=True)]
            u, v = simhash._linked(*got, 4, blocks)
            assert {int(u[0]) % 2**64, int(v[0]) % 2**64} == {a, b} and len(u) == 1
            homes = simhash.at_home(*got, blocks)
            assert all(homes[got[1] == f].sum() == len(blocks) for f in fps)


def forest_of(fps, edges):
    """Edges are links, and join what all links join."""
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    want = components_of(dict(enumerate(fps)))
    place = {f: k for k, f in enumerate(fps)}
    above = {k: k for k in want}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        x, y = root(place[a]), root(place[b])
        above[max(x, y)] = min(x, y)
    assert {k: root(k) for k in want} == want


def test_simhash_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_encoders_are_the_library(tokenizer):
    path = tokens.tokenizer_path()
    both = [tokens.encoder(path), trie_bpe.encoder(path)]
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "\0", "a", "B", "é", "1", "22", "'s", "'t", "!", "...", "<|endoftext|>", "　", "日本", "x y", "\x1c", "\x85", "​", " \n", "\r\n", "ſ", "word"]
    cases = ["", *(t or "" for _, t in texts()), *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(1500))]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in cases]
    for enc in both:
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(cases)] == want
    raw = [np.array(ids, "<u4").tobytes() for ids in want]
    assert [both[1].decode(x) for x in raw] == [tokenizer.decode(ids, skip_special_tokens=False) for ids in want]


def test_library_model_gets_words(tokenizer):
    """words of letters go to the library's model; its whole pipeline, dearer by far, gets only what is none."""
    enc = tokens.LibraryEncoder(tokens.tokenizer_path())
    whole = []

    class Counted:
        def encode_batch_fast(self, some, **how):
            whole.extend(some)
            return tokenizer.encode_batch_fast(some, **how)

    enc.tokenizer = Counted()
    text = "Qwrtzu, qwrtzu qwrtzu. Übrzq (vbnmqx)\nqwrtzu vbnm! x1y <|endoftext|> Жщъц\nÜbrzq."
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(whole) == sorted([",", ".", "!", " (vbnmqx)", " x1y", " <|endoftext|>"])


def test_library_encoder_letters_of_all_scripts(tokenizer):
    rng = random.Random(2)
    letters = [c for c in map(chr, range(0x110, 0x20000)) if c.isalpha()]
    words = ["".join(rng.choice(("a", rng.choice(letters))) for _ in range(rng.randint(1, 5))) + rng.choice(("", "", ",", "'s", "1.", "\u0301")) for _ in range(20_000)]
    cases = [rng.choice((" ", "\n")).join(words[k : k + 8]) for k in range(0, len(words), 8)]
    got = tokens.LibraryEncoder(tokens.tokenizer_path()).encode(cases)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in tokenizer.encode_batch(cases, add_special_tokens=False)]


@pytest.mark.parametrize("added", ["word", "rd,", "é"])
def test_library_encoder_added_token_of_letters(tokenizer, tmp_path, added):
    from tokenizers import AddedToken, Tokenizer

    path = str(tmp_path / "added.json")
    more = Tokenizer.from_str(tokenizer.to_str())
    more.add_tokens([AddedToken(added, normalized=False)])
    more.save(path)
    cases = ["a word, words", "swords\nword.", "Édé é, caféword", "wo rd,"]
    got = tokens.LibraryEncoder(path).encode(cases)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [more.encode(t, add_special_tokens=False).ids for t in cases]


def test_library_encoder_forgets(tokenizer, monkeypatch):
    """What is known is taken over from the generation before, and no more than two are kept."""
    monkeypatch.setattr(tokens.LibraryEncoder, "most", 5)
    enc = tokens.LibraryEncoder(tokens.tokenizer_path())
    for text in ("a b c d, e f g", "a  b", "c d, h i j k", "", "a b\tc", "a b c d, e f g"):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert "\n" not in enc.known and len(enc.known) + len(enc.known.before) < 30 and not getattr(enc.known.before, "before", None)


def test_trie_query_digests(spark, tokenizer):
    rows = texts()
    got = trie_bpe.encoded(documents(spark, rows), digests=True)
    for r in got.collect():
        ids = tokenizer.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_text, r.decoded) == (len(ids), ",".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 31])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 999).astype("<u4")
    raw = tokens.pack_bits(ids, bits)
    assert len(raw) == -(-999 * bits // 8)
    assert (tokens.unpack_bits(raw, bits, 0, 999) == ids).all() and (tokens.unpack_bits(raw, bits, 321, 77) == ids[321:398]).all()


def test_token_files(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 500)
    rows = [*texts(), (3, "again")]
    rows = [(None, "nameless"), *rows]
    path = str(tmp_path / "ids")
    tokens.write_token_files(documents(spark, rows), path)
    got = tokens.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at, by = 0, defaultdict(list)
    for i, t in rows:
        by[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in by[r.doc_id]
        at += len(ids)
    assert tokens.read_document(spark, path, 5).tolist() == by[5][0] and tokens.read_document(spark, path, 999) is None
    assert tokens.with_crc(tokens.read_token_files(spark, path)).where("doc_id = 5").first().ids_crc32 == zlib.crc32(np.array(by[5][0], "<u4").tobytes())


def test_empty_tables(spark, tmp_path):
    none = documents(spark, []).limit(0)
    path = str(tmp_path / "ids")
    tokens.write_token_files(none, path)
    assert tokens.read_token_files(spark, path).count() == 0 and tokens.read_document(spark, path, 1) is None
    assert packing.packed(none).count() == trie_bpe.encoded(none, digests=True).count() == langid.identified(none).count() == 0


def test_rows_without_ids(spark, tokenizer):
    rows = [(None, "a text"), (None, None), (4, "other")]
    got = sorted((r.n_tokens, r.decoded) for r in trie_bpe.encoded(documents(spark, rows), digests=True).collect())
    assert got == sorted((len(tokenizer.encode(t or "", add_special_tokens=False).ids), t or "") for _, t in rows)
    prints = simhash.near_duplicates(documents(spark, rows)).select("doc_id", simhash.hexadecimal().alias("h"), "component_id").collect()
    assert sorted((r.doc_id or 0, r.h) for r in prints) == sorted((i or 0, format(fingerprint(t), "016x")) for i, t in rows)


def test_packing_of_one_length(spark, monkeypatch):
    """Two kinds of rows: ranks over many tasks, with and without broadcast sums, leave no gap."""
    for few in (packing.BROADCAST_SUMS, 0):
        monkeypatch.setattr(packing, "BROADCAST_SUMS", few)
        got = packing.packed(documents(spark, [(1, "one")] * 200 + [(2, "a b c d")] * 90).repartition(7), capacity=10).collect()
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        assert len(got) == 290 and all(a == b for x in bins.values() for (a, _), b in zip(sorted(x), np.cumsum([0] + [n for _, n in sorted(x)]), strict=False))
        assert len(bins) == -(-sum(r.length for r in got) // 10) and max(sum(n for _, n in x) for x in bins.values()) <= 10


def test_packing(spark, tokenizer):
    rows = texts()
    got = packing.packed(documents(spark, rows), keep_ids=True).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for items in bins.values():
        items.sort()
        assert [a for a, _ in items] == list(np.cumsum([0] + [n for _, n in items[:-1]])) and sum(n for _, n in items) <= 1024
    for i, t in rows:
        own = sorted(docs[i], key=lambda r: r.piece)
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 2


def test_plans():
    rng = random.Random(2)
    for _ in range(200):
        cap = rng.choice([3, 30, 100, 1024])
        counts = {rng.randint(1, cap): rng.randint(1, 60) for _ in range(rng.randint(0, 30))}
        slots, bins = sorted(packing.plan(counts, cap)), defaultdict(list)
        for length, n in counts.items():
            own = [s for s in slots if s[0] == length]
            for rank in range(n):
                _, first, m, sequence, offset = [s for s in own if s[1] <= rank][-1]
                bins[sequence + (rank - first) % m].append((offset + length * ((rank - first) // m), length))
        for items in bins.values():
            items.sort()
            assert [a for a, _ in items] == list(np.cumsum([0] + [n for _, n in items[:-1]])) and sum(n for _, n in items) <= cap
        big = sum(n for length, n in counts.items() if length > cap / 2)
        assert len(bins) >= max(big, -(-sum(k * n for k, n in counts.items()) // cap))


def code_length(model, k, text):
    """PPM over dictionaries, byte by byte."""
    counts = [defaultdict(dict) for _ in range(langid.MAX_ORDER + 1)]
    for code, n in zip(*(x.tolist() for x in model.grams[k]), strict=True):
        run = code.to_bytes(4, "big")
        for order in range(langid.MAX_ORDER + 1):
            own = counts[order][run[3 - order : 3]]
            own[run[3]] = own.get(run[3], 0) + n
    bits, past = 0.0, bytes([langid.START] * langid.MAX_ORDER)
    for x in text.encode():
        p = 1.0
        for order in range(langid.MAX_ORDER, -2, -1):
            if order < 0:
                p /= 256
                break
            own = counts[order].get(past[len(past) - order :])
            if own:
                total = sum(own.values()) + len(own)
                if x in own:
                    p *= own[x] / total
                    break
                p *= len(own) / total
        bits -= np.log2(p)
        past += bytes([x])
    return bits


def test_scripts_of_many_bytes(spark):
    """Languages that differ only in bytes beyond ASCII, with many of these, are told apart."""
    rng = random.Random(3)
    draw = lambda a, n: "".join(chr(rng.randint(a, a + 60)) if rng.random() < 0.85 else " " for _ in range(n))
    bases = {"ge": 0x10D0, "am": 0x1200, "ar": 0x0621, "el": 0x0391, "ru": 0x0410, "hi": 0x0904, "ta": 0x0B85, "ja": 0x3041}
    rows = [(k * 10 + j, draw(a, 200), name, 0, 0.0) for k, (name, a) in enumerate(bases.items()) for j in range(10)]
    model = langid.fit(spark.createDataFrame(rows, DOC))
    asked = spark.createDataFrame([(k, draw(a, 12) + chr(a), name, 0, 0.0) for k, (name, a) in enumerate(bases.items())], DOC)
    assert all(r.lang_pred == r.lang for r in langid.predict(asked, model).collect())


def test_language_id(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("score"))
    model = langid.fit(docs.where(~langid.held_out()))
    cases = ["Hello the world ñ €uro", "für die ÜBER   12", "x", "", "", "Привет, мир", "漢字 und das", "a\0b", "of the " * 30]
    want = [[code_length(model, k, text) for k in range(len(model.languages))] for text in cases]
    data = np.frombuffer("".join(cases).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in cases)])
    for chunk in (langid.CHUNK, 5):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(model.lengths(data, at), want, rtol=1e-4)
    held = langid.predict(docs, model).where(langid.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    odd = langid.predict(documents(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "ß"), (None, "the and of")]), model).collect()
    assert [r.lang_pred == "und" for r in odd] == [True, True, True, False, False] and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_licences(spark):
    rows = [
        (1, "Under the MIT, license. under-the mit license"), (2, "x CC BY NC cc by nc"), (3, "Licensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, "the license of the public is general"),
        (7, "This work is licensed under the GNU General Public License, version 3."), (8, "Ünder the mit license"), (9, "apache license version 20"), (10, "permission is hereby granted free of charge to any person obtaining a copy of the software"), (10, "repeated"),
    ]
    got = {(r.doc_id, r.n_words): r for r in licences.scan(documents(spark, rows)).collect()}
    assert len(got) == 11
    a = got[1, 8]
    assert (a.n_base, a.first_word, a.last_word, a.base_labels, a.score) == (2, 0, 4, "mit", 1.0)
    assert (got[2, 7].n_base, got[2, 7].first_word, got[2, 7].last_word) == (2, 1, 4)
    assert (got[3, 8].base_labels, got[3, 8].labels, got[4, 0].labels, got[5, 0].score) == ("apache-2", "apache-2", "", 0.0)
    assert got[6, 7].labels == "" and got[7, 12].labels == "gpl" and got[8, 4].n_base == got[9, 4].n_base == 0
    assert got[10, 16].labels == "mit" and 0.8 <= got[10, 16].score < 1
    assert licences.scan(documents(spark, []).limit(0)).count() == 0


NOTICES = {
    "Released under the BSD license": "bsd",
    "released under the GPL license": "",
    "licensed under a Creative Commons Attribution license": "cc-by",
    "licensed under a Creative Commons Attribution ShareAlike license": "cc-by-sa",
    "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 license": "cc-by-nc-sa",
    "licensed under the GNU General Public License v3": "gpl",
    "licensed under the GNU Lesser General Public License": "lgpl",
    "licensed under CC BY 4.0": "cc-by",
    "licensed under CC-BY-SA 4.0": "cc-by-sa",
    "licensed under CC BY-NC 4.0": "cc-by-nc",
    "the city released a report under which the license of the shop ends": "",
    "he was released from the license office under the rule of mit alone": "",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": "mpl-2",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n": "apache-2",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "gpl",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "MIT License or Apache License, Version 2.0": "apache-2",
}


def test_licence_labels_are_exact(spark):
    """Each notice alone and within other words, far from the beginning."""
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["of", "the", "and", "in", "stone", "river", "to", "a"]) for _ in range(n))
    rows = [(k, t) for k, t in enumerate(NOTICES)] + [(100 + k, f"{filler(60 + k)} {t} {filler(90)}") for k, t in enumerate(NOTICES)]
    got = {r.doc_id: r.labels for r in licences.scan(documents(spark, rows)).collect()}
    assert {k: got[k] for k, _ in enumerate(NOTICES)} == dict(enumerate(NOTICES.values()))
    assert {k: got[100 + k] for k, _ in enumerate(NOTICES)} == dict(enumerate(NOTICES.values()))


def test_licences_by_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(10)
    words = sorted({w for t in licences.TEMPLATES for w in t.words.split()}) + ["stone", "river", "ÄÖ", "K"]  # the last is a Kelvin sign
    rows = [(k, " ".join(rng.choice(words) if rng.random() < 0.2 else w for w in rng.choice(list(NOTICES)).split() * rng.randint(1, 3))) for k in range(80)]
    rows += [(80, None), (81, ""), (82, " ,"), (None, "under the mit license")]
    documents(spark, rows).write.parquet(f"{tmp_path}/d.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet/*.parquet'")
    frame = licences.scan(spark.read.parquet(f"{tmp_path}/d.parquet"))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in frame.collect()), key=key) == sorted(duckdb.sql(licences.oracle()).fetchall(), key=key)


def page(body, head=""):
    return f'<!DOCTYPE html><html><head><title>t</title>{head}<script>if (a<b) "</p>";</script></head><body class="no-ads"><nav><a href="/">Home</a></nav>{body}<footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(("html", "want"), [
    (page("<article><h1>A &amp; B</h1><p><b>One<br>two <p>Three&nbsp; four</article>"), ["A & B", "One two", "Three four"]),
    (page('<div class="sidebar">no</div><main><p>Yes</p><div class="comments"><p>no</p></div><aside>no</aside></main>'), ["Yes"]),
    (page("<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>Body</p><form>no<button>no</button></form></article>"), ["Title", "Body"]),
    (page('<div id="cookie-notice">no</div><div><p>Long text of the page that is the main one.</p><p>And more.</p></div><div><a href="#">links</a> <a href="#">only</a></div>'), ["Long text of the page that is the main one.", "And more."]),
    (page('<article><p>x < y &lt; z</p><!-- no --><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>'), ["x < y < z", "a", "b", "c", "d"]),
    (page('<article><p>Cut off in <b>the middle'), ["Cut off in the middle"]),
    ("", []), ("no tags at all", ["no tags at all"]), ("<<<>>> <a <b", None),
])
def test_article_of_page(html, want):
    got = [x.text for x in htmltext.article(htmltext.parse(html))]
    assert want is None or got == want


def random_tree(rng, depth):
    node = htmltext.Node(rng.choice(["div", "p", "ul"]), None)
    node.text = ""
    for _ in range(rng.randint(0, 4) if depth else 0):
        node.children.append(random_tree(rng, depth - 1))
    return node


def best_matching(a, b):
    """The most nodes that two trees match in order, by trying all."""
    if a.tag != b.tag:
        return 0

    def lists(x, y):
        if not x or not y:
            return 0
        w = best_matching(x[0], y[0])
        return max(lists(x[1:], y), lists(x, y[1:]), (w + lists(x[1:], y[1:])) if w else 0)

    return 1 + lists(a.children, b.children)


def test_tree_matching():
    m = wrappers.Matcher()
    a, b = htmltext.parse("<div><p>x</p><ul><li>1<li>2</ul><p>y</p></div>"), htmltext.parse("<div><h1>t</h1><p>x</p><p>z</p></div>")
    m.shape(a)
    m.shape(b)
    assert [(x.text, y.text) for x, y in sorted(m.aligned(a, b), key=lambda p: p[0].text) if x.text] == [("x", "x"), ("y", "z")]
    rng = random.Random(8)
    for _ in range(150):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        m.shape(a)
        m.shape(b)
        assert m.weight(a.place, b.place) == best_matching(a, b)
        if a.tag == b.tag:
            assert len(list(m.aligned(a, b))) == best_matching(a, b)


def by_host(pages):
    """extract() in plain Python over (page_id, url, html)."""
    hosts, out = defaultdict(list), {}
    for i, url, html in pages:
        hosts[(url or "").split("/")[2] if "://" in (url or "") else ""].append((i, html or ""))
    for own in hosts.values():
        matcher = wrappers.Matcher()
        full = sorted(x for x in own if x[1])
        if not full:
            out |= {i: "" for i, _ in own}
            continue
        made = wrappers.Wrapper(full[0][1], matcher)
        read = {i: wrappers.read(html, made, matcher) if html else [] for i, html in own}
        once = {tuple(t for t, *_, m in got if m & wrappers.OWN): got for _, got in sorted(read.items()) if got}
        counts = defaultdict(lambda: [0, 0.0])
        for got in once.values():
            for text, slot, same, marks in got:
                x = counts[slot, same]
                x[0] += 1
                x[1] += 0 if marks & (wrappers.DROPPED | wrappers.LINKED) else len(text) * (htmltext.ROOTED if marks & wrappers.LIKELY else 1)
        spans, likely, template = wrappers.induced(made, [(*k, *v) for k, v in counts.items()], len(once))
        for i, got in read.items():
            stay = [x for x in got if not x[3] & (wrappers.DROPPED | wrappers.LISTED) and x[2] not in template]
            ours = [x for x in stay if any(a <= x[1] <= b for a, b in spans) and (not likely or x[3] & wrappers.LIKELY)]
            chosen = ours if any(not x[3] & wrappers.LINKED for x in ours) else [x for x in stay if x[3] & wrappers.OWN]
            out[i] = "\n\n".join(x[0] for x in chosen)
    return out


def truth(html):
    """The article of a page of the test tables: what stands between its tags."""
    import html as h

    body = html[html.index("<article>") + 9 : html.index("</article>")]
    return [x for x in (" ".join(h.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body)) if x]


def test_wrappers_of_the_test_tables(spark, monkeypatch):
    """Spark against plain Python and the articles; class names play no part."""
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = [(r.page_id, r.url, r.html) for r in frame.collect()]
    want = by_host(pages)
    assert {r.page_id: r.text for r in wrappers.extract(frame).collect()} == want
    monkeypatch.setattr(htmltext, "MARKS", frozenset())
    monkeypatch.setattr(htmltext, "ARTICLE_MARKS", frozenset())
    assert by_host(pages) == want
    assert sum(want[i].split("\n\n") == truth(html) for i, _, html in pages) >= 0.95 * len(pages)


def test_wrappers_without_names(spark):
    """Pages whose markup says nothing: the longest text is the template's, the article is what varies; alone, a page gives the template."""
    legal = "<p>" + "All rights are reserved by the owners of this site and may not be used. " * 12 + "</p>"
    rows = []
    for i in range(9):
        text = "".join(f"<p>Story {i} has part {k}, which no other page has.</p>" for k in range(2 + i % 3))
        rows.append((i, f"http://bare.example/{i}", f"<body><div><div><b>Menu</b></div><div><h1>Title {i}</h1>{text}<div>Print this page</div></div></div><div>{legal}{legal}</div></body>", 0))
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    assert got == by_host([r[:3] for r in rows])
    for i in range(9):
        assert got[i].split("\n\n") == [f"Title {i}", *[f"Story {i} has part {k}, which no other page has." for k in range(2 + i % 3)]]
        assert [x.text for x in htmltext.article(htmltext.parse(rows[i][2]))] != got[i].split("\n\n")


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-comments", "post with-share", "content widget-free", "col related-none"])
def test_class_names_that_only_hold_a_word(name):
    html = f'<body><div class="{name}"><h1>T</h1><p>The text of the page.</p><p class="reply">More of it.</p></div><div class="sidebar-left">no</div><div id="cookie_notice">no</div></body>'
    assert [x.text for x in htmltext.article(htmltext.parse(html))] == ["T", "The text of the page.", "More of it."]


def test_markup_never_drops_most_of_a_page():
    html = '<body><form class="widget"><p>A page that stands in a form as a whole.</p><div class="ad">no</div></form><nav><p>a</p></nav></body>'
    assert [x.text for x in htmltext.article(htmltext.parse(html))] == ["A page that stands in a form as a whole."]


def test_deep_pages(spark):
    rows = [(i, "http://deep.example/", "<div>" * n + f"<p>text {i}</p>" + "<span>" * n + "</div>" * n, 0) for i, n in enumerate([3000, 3000, 2999, 1, 5000, 40])]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, x int")).collect()}
    assert got == {i: f"text {i}" for i in range(6)}


def test_wrappers(spark):
    share = "<p>Share this page with friends.</p>"
    rows = [(i, f"http://h.example/{i}", page(f"<article><h1>T{i}</h1><p>Text {i} of its own.</p>{share}</article>"), 1) for i in range(8)]
    rows += [(20, "http://one.example/", page(f"<article><p>Alone.</p>{share}</article>"), 1), (21, None, None, 1), (22, "http://h.example/x", "", 1), (3, *rows[3][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    for limit in (wrappers.BROADCAST_BYTES, -1):
        got = sorted((r.page_id, r.text, r.n_chars) for r in wrappers.extract(pages, limit).collect())
        want = [(i, f"T{i}\n\nText {i} of its own.") for i in (0, 1, 2, 3, 3, 4, 5, 6, 7)] + [(20, "Alone.\n\nShare this page with friends."), (21, ""), (22, "")]
        assert got == [(i, t, len(t)) for i, t in want]
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_wrappers_of_pages_that_differ_in_length(spark, monkeypatch):
    notice = "<p>Sign up for the letter of this site.</p>"
    counts = [3, 1, 2, 4, 5, 7, 1, 2]
    rows = [(i, f"http://h.example/{i}", page("<article><h1>T%d</h1>%s%s</article>" % (i, "".join(f"<p>Text {i} {k}.</p>" for k in range(n)), notice)), 1) for i, n in enumerate(counts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    want = {i: "\n\n".join([f"T{i}", *[f"Text {i} {k}." for k in range(n)]]) for i, n in enumerate(counts)}
    assert {r.page_id: r.text for r in wrappers.extract(pages).collect()} == want
    m, found = wrappers.Matcher(), []
    for grid in (wrappers.GRID, 4):
        monkeypatch.setattr(wrappers, "GRID", grid)
        a, b = htmltext.parse(rows[5][2].replace("Text 5", "<b>Text 5</b>", 1)), htmltext.parse(rows[0][2])
        m.shape(a)
        m.shape(b)
        pairs = list(m.aligned(a, b))
        found.append((len(pairs), sum(x.text == y.text for x, y in pairs if x.text)))
    assert found[0] == found[1]
