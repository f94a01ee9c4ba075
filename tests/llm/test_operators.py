"""Every operator over nulls, empty and long texts, repeats, ties, clashing columns and an empty table, against brute force."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from llm_texts import TEXTS
from pyspark.sql import functions

from keelson.llm import licenses, mixing, mixing_model, packed, pieces, quality, shingles, simhash, suffixes, toxicity, vectors
from keelson.llm.common import Forest
from keelson.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df_rows=TEXTS):
    return [(i, t or "") for i, t in df_rows]


@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith("op10")])
def test_empty_table(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


def test_fingerprints_and_components(spark, edge):
    got = rows(simhash.op4_simhash_near_dedup(spark, edge))
    assert len(got) == len(TEXTS)

    def brute(text):
        w = text.encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        c = [0] * 64
        for x in s:
            h = xxhash.xxh64_intdigest(x, 42)
            for b in range(64):
                c[b] += h >> b & 1
        return sum((2 * c[b] > len(s)) << b for b in range(64))

    fps = [brute(t) for _, t in texts()]
    f = Forest(len(fps))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                f.join(np.array([a]), np.array([b]))
    ids = [i for i, _ in TEXTS]
    want = [(i, f"{fp:016x}", min((ids[k] for k in range(len(ids)) if f.parent[k] == f.parent[j] and ids[k] is not None), default=None)) for j, (i, fp) in enumerate(zip(ids, fps))]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def test_links_lose_none_in_large_buckets(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 12, 200).astype(np.uint64)) for b in base])
    whole = simhash.bucket_links(fps, 2)
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    wild = simhash.bucket_links(fps, 2)
    for a, b in (whole, wild):
        f = Forest(len(fps))
        f.join(a, b)
        assert len(set(f.parent)) == 3
    n, both = 1000, np.full((64, 64), 250.0) + np.eye(64) * 250
    for distance in (0, 1, 2, 5, 11):
        segments = simhash.plan(n, both, distance)
        assert sum(t + 1 for _, t in segments) == distance + 1 and sorted(b for s, _ in segments for b in s) == list(range(64))
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = a.copy()
        for k in range(distance):
            b ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        assert (simhash.probe_keys(a, segments) == simhash.probe_keys(b, segments)).any(axis=0).all()


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(25, 41), replace=False), rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)]) for _ in range(30)]
        label = rng.integers(0, 25, 30)
        links = [(i, j) for i in range(30) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        same = [(i, j) for i in range(30) for j in range(i) if label[i] == label[j]]
        got, want = Forest(30), Forest(30)
        for f, pairs in ((got, list(zip(*shingles.forest(sets, label))) + same), (want, links + same)):
            f.join(*(np.array(x, int) for x in zip(*pairs)))
        assert got.parent.tolist() == want.parent.tolist()


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_dedup(spark, edge, collide, monkeypatch):
    """Also where the first hash of a text has three values only."""
    if collide:
        monkeypatch.setattr(suffixes, "text_hash", lambda text: functions.length(text) % 3)
    got = rows(suffixes.op6_suffix_array_dedup(spark, edge))
    first = {}
    for i, t in sorted(((i if i is not None else 1 << 62, t) for i, t in texts())):
        b = t.encode()
        for q in range(len(b) - 49):
            first.setdefault(b[q : q + 50], i)
    want = []
    for i, t in texts():
        b, me = t.encode(), i if i is not None else 1 << 62
        gone = np.zeros(len(b) + 1, bool)
        for q in range(len(b) - 49):
            if first[b[q : q + 50]] < me:
                gone[q : q + 50] = True
        gone = gone[:-1]
        want.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("alphabet", [2, 3, 250])
def test_merged_transforms(alphabet, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 300)
    rng = random.Random(alphabet)
    for length in (5, 50):
        base = [bytes(rng.randrange(alphabet) for _ in range(rng.randint(length, length + 90))) for _ in range(12)]
        snippets = base + [base[0][3:] + base[1], base[2], base[2] * 2]
        docs = np.array([rng.randrange(6) for _ in snippets])
        windows = np.array([len(s) - length + 1 for s in snippets])
        windows[0] //= 2
        windows = np.maximum(windows, 1)
        flags, starts = suffixes.repeated_windows(snippets, windows, docs, length)
        got = [flags[a : a + w] for a, w in zip(starts, windows)]
        least = {}
        for s, w, d in zip(snippets, windows, docs):
            for q in range(w):
                least[s[q : q + length]] = min(d, least.get(s[q : q + length], 99))
        for s, w, d, g in zip(snippets, windows, docs, got):
            assert g.tolist() == [least[s[q : q + length]] < d for q in range(w)]


def test_minimisers_cover_windows():
    text = np.frombuffer(os.urandom(3000), np.uint8)
    whole = suffixes.window_minimisers(text, 50)
    assert len(whole) == 2951 and len(suffixes.window_minimisers(text[:49], 50)) == 0
    for a in (0, 17, 2900):
        assert suffixes.window_minimisers(text[a : a + 50], 50)[0] == whole[a]


def test_quality_rules(spark, edge):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{edge}/documents.parquet/*.parquet')")
    found = con.execute(quality.OP3_SQL)
    names = [c[0] for c in found.description]
    want = Counter(tuple(r) for r in found.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in rows(quality.op3_quality_rules(spark, edge))) == want


@pytest.mark.parametrize("name", ["license_base_places", "lm_base_scores"])
def test_base_columns_on_odd_rows(spark, edge, empty, name):
    for folder in (edge, empty):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        found = con.execute(oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert Counter(tuple(r[n] for n in names) for r in rows(queries()[name](spark, folder))) == Counter(found.fetchall())


def test_frequent_lines_deplete(spark):
    page = "\n".join(f"boilerplate line {w} that very many pages have" for w in "abcdefghij")
    docs = spark.createDataFrame([(i, page, "h") for i in range(30)] + [(100 + i, " ".join(f"own{i}{k}" for k in range(80)), "h") for i in range(30)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in rows(quality.quality(docs, most=20))}
    assert not any(got[i] for i in range(30)) and all(got[100 + i] for i in range(30))


@pytest.mark.parametrize("name", ["op3_quality_rules", "op6_suffix_array_dedup", "op10_embedding_near_dedup", "license_base_places", "lm_base_scores"])
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = con.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in rows(got)) == Counter(found.fetchall())


def test_licenses(spark, edge):
    got = {r["doc_id"]: r for r in rows(licenses.op7_license_scan(spark, edge))}
    r = got[9]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (3, 3, 7, "mit", "cc-by-nc,mit,mit-notice", 1.0)
    assert got[4]["n_words"] == 0 and got[4]["score"] == 0 and got[4]["first_word"] is None
    accept = lambda p, t: licenses.compiled(p).run(t.encode().split(), 0)[0]
    assert accept("a [[ b c ]] d", "a d") == 2 and accept("a [[ b c ]] d", "a b c d") == 4 and accept("a [[ b c ]] d", "a b d") is None
    assert accept("a {2} d", "a d") == 2 and accept("a {2} d", "a x y d") == 4 and accept("a {2} d", "a x y z d") is None
    assert accept("a {2:[0-9]+} d", "a 1 23 d") == 4 and accept("a {2:[0-9]+} d", "a x d") is None


def filled(template, drop=False):
    """A text that a template accepts: optional parts in or out, others replaced."""
    text = re.sub(r"\{(\d+)(?::[^}]*)?\}", "2", template)
    while "[[" in text:
        text = re.sub(r"\[\[([^\[\]]*)\]\]", "" if drop else r"\1", text)
    return text.split()


@pytest.mark.parametrize("label", licenses.TEMPLATES)
def test_license_texts_match_whole_or_not_at_all(label):
    template = licenses.TEMPLATES[label]
    automaton = licenses.compiled(template)
    plain = re.compile(plain_pattern(template))
    for words in (filled(template), filled(template, True)):
        text = ["before", *words, "after"]
        joined = " ".join(text).encode()
        assert licenses.scan([w.encode() for w in text], joined, automaton)[0] and plain.search(" ".join(text) + " ")
        for k in range(1, len(words), 7):
            for broken in (words[:k] + words[k + 1 :], [*words[:k], "other", *words[k + 1 :]]):
                found = licenses.scan([w.encode() for w in broken], " ".join(broken).encode(), automaton)
                assert bool(found[0]) == bool(plain.search(" ".join(broken) + " ")) and (found[0] or found[1] < 1)


def plain_pattern(template):
    """The template as a regular expression over words that each have a space after them."""
    out = []
    for token in template.split():
        m = re.fullmatch(r"\{(\d+)(?::(.+))?\}", token)
        out.append("(?:" if token == "[[" else ")?" if token == "]]" else f"(?:{m[2] or r'\S+'} ){{0,{m[1]}}}" if m else f"{token} ")
    return r"(?<!\S)" + "".join(out)


def test_license_automata_against_regular_expressions():
    rng = random.Random(9)
    for _ in range(400):
        parts = ["a"]
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(["a", "b", "c", "{1}", "{2}", "{2:[ab]}", "[[ a ]]", "[[ b c ]]", "[[ a [[ b ]] ]]"]))
        template = " ".join([*parts, "d"])
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        text = " ".join(words) + " "
        plain = re.compile(plain_pattern(template))
        want = [i for i in range(len(words)) if plain.match(text, 2 * i)]
        assert licenses.scan([w.encode() for w in words], text.encode(), licenses.compiled(template))[0] == want


def test_token_files(spark, edge):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packed.vocabulary_path())
    want, start = [], 0
    for i, t in sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = coder.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows(packed.op8_token_binary(spark, edge)))
    assert [(i, s, n, c) for s, i, n, c in got] == want


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32])
def test_packing_round_trip(width, tmp_path):
    rng = np.random.default_rng(width)
    path = tmp_path / "x.ids"
    docs = [rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5000, 4096, 63)]
    with open(path, "wb") as f:
        w = packed.Writer(f, 2**width)
        for i, d in enumerate(docs):
            w.add([None if i == 1 else i], d, [len(d)])
        assert w.close() == (5, sum(map(len, docs)))
    raw = path.read_bytes()
    found = packed.TokenFile(lambda a, n: raw[a : a + n], len(raw))
    assert all((found.document(i) == d).all() for i, d in enumerate(docs)) and found.null.tolist() == [False, True, False, False, False]
    assert len(raw) < sum(map(len, docs)) * width / 8 + 2000


def test_pieces(spark, edge):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter()
    for i, t in texts():
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r.values()) for r in rows(pieces.op9_sentencepiece(spark, edge))) == want


def test_pieces_on_random_text():
    coder = pieces.Encoder(pieces.model_path())
    rng = random.Random(2)
    found = ["".join(rng.choice("abct heionrs▁ \n1é日") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    want = coder.library.encode(found, add_bos=True, add_eos=True)
    assert [x.tolist() for x in coder.prepared(found)] == want
    again = coder.merged(["▁" + f.replace(" ", "") for f in found[:200]], True)
    assert again == coder.merged(["▁" + f.replace(" ", "") for f in found[:200]])


def test_mixing(spark, edge):
    got = rows(mixing.op5_source_mixing(spark, edge))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert {r["doc_id"]: r["size"] for r in got if r["doc_id"]} == {i: len(t.encode().split()) for i, t in texts() if i}
    sources = spark.createDataFrame([("b", 10, 1), (None, 100, 1), ("a", 1000, 1)], "source string, source_size long, units long")
    assert {r["source"]: r["target"] for r in mixing.targets(sources, (5, 2, 1), 1.5, 2.0).collect()} == {"a": pytest.approx(1445), "b": 20, None: pytest.approx(200)}
    docs = spark.createDataFrame([(i, "w " * (i % 37), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    first = rows(mixing.mixed(docs, chunk=100))
    for s in ("s0", "s1", "s2"):
        part = [r for r in first if r["source"] == s]
        goal = part[0]["target"]
        assert abs(sum(r["taken"] for r in part) - goal) < 40 and abs(sum(r["copies"] for r in part) - 1000 * goal / part[0]["source_size"]) < 3
    assert sorted(map(str, rows(mixing.mixed(docs, chunk=100)))) == sorted(map(str, first))


def plain_targets(sizes, weights, share, limit):
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = {}
    while True:
        rest = [s for s in sizes if s not in full]
        left = share * sum(sizes.values()) - sum(full.values())
        got = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: limit * sizes[s] for s in rest if got[s] > limit * sizes[s]}
        if not over:
            return full | got
        full |= over


def test_targets_against_a_plain_version(spark):
    rng = random.Random(10)
    for n in (1, 4, 40):
        sizes = {f"s{i}é"[: rng.randint(2, 5)] + str(i): int(10 ** rng.uniform(0, 5)) for i in range(n)} | ({None: 77} if n > 1 else {})
        sources = spark.createDataFrame([(s, z, 1) for s, z in sizes.items()], "source string, source_size long, units long")
        got = {r["source"]: r["target"] for r in mixing.targets(sources, (5, 2, 1), 1.5, 2.0).collect()}
        assert got == {s: pytest.approx(t) for s, t in plain_targets(sizes, (5, 2, 1), 1.5, 2.0).items()}


def test_flight_keeps_its_totals():
    rng = np.random.default_rng(4)
    size, p = rng.integers(1, 500, 400), np.full(400, 0.37)
    out = mixing.flight(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3


def test_lm_scores(spark, edge):
    got = rows(mixing_model.op2_lm_scoring(spark, edge))
    counts = Counter()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in texts():
        if not out(i):
            counts.update([*t.encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    want = {i: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.encode().lower().split(), b" "]) for i, t in texts()}
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["base_score"] == pytest.approx(want[r["doc_id"]], rel=1e-9) and r["held_out"] == out(r["doc_id"]) and r["train_tokens"] == n
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_lm_beats_its_base_on_held_out_text(spark):
    held = [r for r in rows(mixing_model.op2_lm_scoring(spark, SF)) if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_base_scores_learn_no_weights(spark, edge, monkeypatch):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    want = sorted(map(str, mixing_model.scored(mixing_model.documents(spark, edge)).select(*columns).collect()))

    def learned(*_):
        raise AssertionError("weights are learned")

    monkeypatch.setattr(mixing_model, "learned", learned)
    assert mixing_model.lm_base_scores(spark, edge).count() == len(want)
    assert sorted(map(str, mixing_model.base_scored(mixing_model.documents(spark, edge)).select(*columns).collect())) == want


def test_all_training_documents_teach_the_mixing_model(spark):
    docs = spark.createDataFrame([(i, f"some words {i % 7}") for i in range(200)] + [(None, "no id")], "doc_id long, text string")
    training = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(200)) + 1
    groups = mixing_model.packed_groups(docs, 5, 1)
    assert groups.filter("learns").agg(functions.sum("n_train")).first()[0] == training
    assert not groups.filter("NOT learns AND n_train > 0").count()


def test_lm_scores_follow_from_the_documents_alone(spark, monkeypatch):
    monkeypatch.setattr(mixing_model, "GROUP", 40)
    monkeypatch.setattr(mixing_model, "GROUP_BYTES", 100_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, again = (sorted((r["doc_id"], r["score"], r["base_score"]) for r in mixing_model.scored(docs.repartition(n)).collect()) for n in (1, 6))
    assert first == again


def test_lm_sets_documents_apart_that_occur_twice(spark):
    rng = random.Random(8)
    found = [" ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(200)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(found + found[:20])), "doc_id long, text string")
    bits = {r["doc_id"]: r["bits_per_byte"] for r in mixing_model.scored(docs).collect()}
    out = {i for i in bits if zlib.crc32(str(i).encode()) % 5 == 1}
    twice = [bits[i] for i in range(20) if not {i, i + 120} & out]
    assert max(twice) < 0.7 * min(bits[i] for i in range(20, 120))


@pytest.mark.parametrize("slabs", [1, 3, 50])
def test_lm_counts_are_of_other_documents_and_of_what_went_before(slabs):
    rng = random.Random(slabs)
    found = [[rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    train = np.array([rng.random() < 0.7 for _ in found])
    grams = mixing_model.Grams([" ".join(f).encode() for f in found], train, mixing_model.Reader())
    ended = [f + [" "] for f in found]
    for order in range(3):
        keyed = [[tuple((["<<"] * (order > 0) + f)[max(i + (order > 0) - order, 0) : i + 1 + (order > 0)]) + ((i,) if i < order - 1 else ()) for i in range(len(f))] for f in ended]
        total = Counter(k for ks, t in zip(keyed, train) for k in ks if t)
        to, start, h = grams.sorted(order)
        flat = [k for ks in keyed for k in ks]
        slab, low = mixing_model.slab_of(h, slabs)
        assert len(set(zip(slab.tolist(), low.tolist()))) == len(h) == len(set(flat)) and (np.diff(slab) >= 0).all()
        every, seen = grams.counts(order, np.array([total[flat[to[s]]] for s in start]))
        want = []
        for ks, t in zip(keyed, train):
            own, before = Counter(ks), Counter()
            for k in ks:
                want.append((total[k], total[k] - t * own[k] + before[k]))
                before[k] += 1
        assert list(zip(every.tolist(), seen.tolist())) == want


def test_lm_words_are_hashed_by_length_not_one_by_one(monkeypatch):
    rng = random.Random(3)
    odd = [bytes(rng.choice(b"aZ\x00\x1c\x1f\x80\xff\xc3\xa4~") for _ in range(k)) for k in range(80)]
    found = [(t or "").encode() for _, t in texts()] + odd + [b"", b" ", b"\t\n\x0b\x0c\r", b"one", b" two  w\x1fords ", *(b" ".join(rng.sample(odd, 20)) for _ in range(30))]
    words = [[*t.lower().split(), b" "] for t in found]
    want = [xxhash.xxh64_intdigest(w) for ws in words for w in ws]
    asked = []
    monkeypatch.setattr(mixing_model.xxhash, "xxh64_intdigest", lambda w, hashed=xxhash.xxh64_intdigest: asked.append(w) or hashed(w))
    hashes, size = mixing_model.Reader().words(found)
    assert size.tolist() == list(map(len, words)) and hashes.tolist() == want
    assert all(len(w) >= 32 or w == b" " for w in asked)
    assert [x.tolist() for x in mixing_model.Reader().words([])] == [[], []]


def test_lm_nodes_count_what_came_before_in_the_document():
    rng = np.random.default_rng(5)
    for counts, n in (([30, 9, 9, 4, 2, 1, 1], 400), ([3, 2], 50), ([7], 20), ([5, 1], 0)):
        tree, symbols, doc = mixing_model.tree_of(counts), rng.integers(0, len(counts), n), np.sort(rng.integers(3, 12, n))
        size = tree.start[symbols + 1] - tree.start[symbols]
        before, ones, want = Counter(), Counter(), []
        for d, s in zip(doc.tolist(), symbols.tolist()):
            for node, bit in zip(tree.node[tree.start[s] : tree.start[s + 1]].tolist(), tree.bit[tree.start[s] : tree.start[s + 1]].tolist()):
                want.append((before[d, node], ones[d, node]))
                before[d, node] += 1
                ones[d, node] += bit
        got = mixing_model.earlier(tree, symbols, doc, np.cumsum(size) - size, int(size.sum()))
        assert list(zip(*(x.tolist() for x in got))) == want


def test_lm_bits_are_probabilities():
    tree = mixing_model.tree_of([5, 3, 2, 1, 1])
    p = [np.prod([mixing_model.squash(tree.first[n]) if b else 1 - mixing_model.squash(tree.first[n]) for n, b in zip(tree.node[a:b_], tree.bit[a:b_])]) for a, b_ in zip(tree.start[:-1], tree.start[1:])]
    assert sum(p) == pytest.approx(1)
    flags, bits = mixing_model.mixers()
    for mixer in (flags, bits):
        logit, cell = np.linspace(-14, 14, 50).astype(np.float32), np.zeros(50, int)
        assert (10.0 ** mixer.cost(logit, cell, np.ones(50, int)) + 10.0 ** mixer.cost(logit, cell, np.zeros(50, int))) == pytest.approx(np.ones(50), abs=1e-5)


def test_toxicity(spark, edge):
    got = rows(toxicity.op1_toxicity(spark, edge))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_toxicity_held_out(spark):
    docs = [(i, " ".join(random.Random(i).choice("abcdefghijklmnopqrst") + "word" for _ in range(60)) + (" nasty slur " * 3 if i % 5 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in docs], "doc_id long, toxic int")
    got = [r for r in rows(toxicity.scored(df, toxicity.fitted(df, labels))) if r["held_out"]]
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got) and len(got) > 100


def test_maximal_segments():
    score = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    assert [x[2] for x in toxicity.maximal_segments(score)] == [4, 3, 7]
    assert toxicity.maximal_segments(np.array([-1.0])) == []


def plain_segments(score):
    """Every maximal segment by its definition: the best segment, of equals the shortest and then the first, and so on left and right of it."""
    if not len(score):
        return []
    total = np.r_[0, np.cumsum(score)]
    best, start, end = max(((total[j] - total[i], i - j, -i) for i in range(len(score)) for j in range(i + 1, len(score) + 1)))[0:3], 0, 0
    value, start = best[0], -best[2]
    if value <= 0:
        return []
    end = start - best[1]
    return plain_segments(score[:start]) + [(start, end, value)] + [(s + end, e + end, v) for s, e, v in plain_segments(score[end:])]


def test_maximal_segments_by_definition():
    rng = np.random.default_rng(6)
    for _ in range(300):
        score = rng.integers(-4, 5, rng.integers(0, 24)).astype(float)
        assert sorted(x[2] for x in toxicity.maximal_segments(score)) == sorted(x[2] for x in plain_segments(score))


def test_maximal_segments_take_linear_time():
    for score in (np.tile([1.0, -2.0], 500_000), np.tile([2.0, -1.0], 500_000), np.r_[np.tile([1.0, -2.0], 250_000), np.tile([2.0, -1.5], 250_000)]):
        began = time.process_time()
        toxicity.maximal_segments(score)
        assert time.process_time() - began < 5


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8))
    found = [*base, *(base[:20] + rng.normal(size=(20, 8)) * 0.04), base[0], base[0], base[0] * 3]
    data = [(i, [float(x) for x in v], i % 2 if i < 60 else 0) for i, v in enumerate(found)]
    odd = [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 0), (103, [1.0, None] + [0.0] * 6, 0), (104, data[0][1], None), (None, data[0][1], 0), (105, [1.0, 2.0], 0), (106, [2.0, 4.0], 0), (107, [], 0), (107, [], 0)]
    spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").withColumn("rep", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in rows(vectors.op10_embedding_near_dedup(spark, str(tmp_path)))}
    small = {r["vec_id"]: r for r in rows(vectors.near_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), tile=4))}
    cut = {r["vec_id"]: r for r in rows(vectors.near_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), tile=4, read=0))}
    u = np.array([v / np.linalg.norm(v) for v in found])
    link = (u @ u.T >= 0.98) & (np.array([x[2] for x in data])[:, None] == np.array([x[2] for x in data])[None])
    f = Forest(len(found))
    f.join(*np.nonzero(link))
    for out in (got, small, cut):
        for i in range(len(found)):
            assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (link[i].sum() - 1, f.parent[i], f.parent[i] == i)
        assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (100, 101, 102, 103, 104, 107, None))
        assert out[106]["component_id"] == 105
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vectors.op10_embedding_near_dedup(spark, f"{tmp_path}/none").count() == 0


def test_vectors_of_one_hot_cell_are_stored_once(spark):
    """60 tiles of one cell, in blocks; nothing of the tiles is left behind."""
    import os

    rng = np.random.default_rng(3)
    near = np.r_[np.ones(6)] + rng.normal(size=(900, 6)) * 0.06
    df = spark.createDataFrame([(i, [float(x) for x in v], "hot, 1") for i, v in enumerate(near)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r for r in rows(vectors.near_vectors(df, threshold=0.995, tile=15))}
    u = near / np.linalg.norm(near, axis=1)[:, None]
    link = u @ u.T >= 0.995
    f = Forest(len(near))
    f.join(*np.nonzero(link))
    assert 900 < link.sum() < 810_000
    for i in range(len(near)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (link[i].sum() - 1, f.parent[i])
    shared = vectors.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(shared) and not [x for x in os.listdir(shared) if x.startswith("tiles-")]


def test_pipeline(spark, edge, empty):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    got = rows(corpus_pipeline.run(spark, edge))
    assert set(got[0]) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["ba", "ce", "di", "fo", "gu"]) + rng.choice(["la", "me", "ni"]) + str(rng.randrange(50)) for _ in range(300)) for _ in range(40)]
    near = [b.replace(b.split()[100], "changed", 1) for b in base[:20]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(base + near + base[:5])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in simhash.stage(spark, docs, "").collect()) == list(range(40))


def test_stage_is_brute_force_jaccard(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for target in (0.6, 0.65, 0.7, 0.75, 0.78, 0.8, 0.82, 0.85, 0.88, 0.9):
        for _ in range(25):
            base = [word() for _ in range(300)]
            near, at = base[:], list(range(2, 298))
            rng.shuffle(at)
            shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            while at:
                trial = near[:]
                trial[at.pop()] = word()
                a, b = shingles(base), shingles(trial)
                if len(a & b) / len(a | b) < target:
                    break
                near = trial
            docs += [base, near if target >= 0.8 else trial]
    hub = [word() for _ in range(300)]
    docs += [[*hub[: 10 * k], word(), *hub[10 * k + 1 :]] for k in range(30)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    f = Forest(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                f.join(np.array([a]), np.array([b]))
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted(r["doc_id"] for r in simhash.stage(spark, df, "").collect())
    assert got == sorted(set(f.parent.tolist())) and 250 < len(got) < 500


@pytest.mark.parametrize("block", [1 << 18, 1 << 11])
def test_large_buckets_are_compared_whole(spark, block, monkeypatch):
    """With small blocks, what the first block leaves apart meets the others tile by tile."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    docs = []
    for _ in range(80):
        w = base[:]
        for at in rng.sample(range(200), rng.choice([2, 4, 6, 9])):
            w[at] = word()
        docs.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    f = Forest(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                f.join(np.array([a]), np.array([b]))
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in simhash.stage(spark, df, "").collect()) == sorted(set(f.parent.tolist()))


def test_stage_keeps_rows_by_text_not_by_doc_id(spark):
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    near = texts[1] + " more"
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (4, near), (5, texts[3]), (5, texts[4]), (6, texts[5]), (6, texts[5]), (7, texts[5])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = simhash.stage(spark, df, "").collect()
    want = [(None, texts[0]), (None, texts[2]), (4, near), (5, texts[3]), (5, texts[4]), (6, texts[5])]
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)
