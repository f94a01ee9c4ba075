"""Each pipeline stage on the output of the one before it, against a plain version of what it should do."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from keelson.llm import mixing, pieces, shingles, toxicity
from keelson.llm.common import Forest, documents

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reread(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def without_repeats(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows.items()):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for q in range(len(b) - length + 1):
            if first.setdefault(b[q : q + length], i) < i:
                gone[q : q + length] = True
        out[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore")
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "sentencepiece"]
    docs = documents(spark, SF)
    model = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.scored(docs, model).collect() if not r["predicted"]}

    now = reread(spark, stages["toxicity"](spark, docs, SF), tmp_path / "1")
    assert now.columns == COLUMNS
    assert Counter(map(tuple, now.collect())) == Counter(tuple(r) for r in docs.select(*COLUMNS).collect() if r["doc_id"] in clean)

    before = sorted((r["doc_id"], r["text"]) for r in now.collect())
    now = reread(spark, stages["simhash_near_dedup"](spark, now, SF), tmp_path / "2")
    sets = [set(shingles.shingle_hashes(t.encode(), 5, 42).tolist()) for _, t in before]
    forest = Forest(len(sets))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    forest.join(*(np.array(x, int) for x in zip(*links)))
    assert sorted(r["doc_id"] for r in now.collect()) == [before[i][0] for i in sorted(set(forest.parent.tolist()))]

    want = without_repeats({r["doc_id"]: r["text"] for r in now.collect()})
    now = reread(spark, stages["suffix_array_dedup"](spark, now, SF), tmp_path / "3")
    assert {r["doc_id"]: r["text"] for r in now.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect()) and now.columns == COLUMNS

    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(now).collect() if r["copies"]}
    kept = {r["doc_id"]: tuple(r) for r in now.collect()}
    now = reread(spark, stages["source_mixing"](spark, now, SF), tmp_path / "4")
    assert Counter(map(tuple, now.collect())) == Counter({kept[i]: n for i, n in copies.items()})

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter()
    for r in now.collect():
        ids = sp.encode(r["text"], add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages["sentencepiece"](spark, now, SF).collect())) == want


def test_stages_on_odd_rows(spark, edge):
    """Null ids, sources and texts, repeated ids with equal and other texts, empty and long texts, through every stage by itself."""
    docs = documents(spark, edge)
    odd = spark.createDataFrame([(3, "another text of the id three", "en", "s0", 27), (None, None, None, None, None), (None, "two words", None, "s1", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*COLUMNS).union(odd)
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fitted(docs, spark.read.parquet(f"{edge}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    want = [r for r in rows if scorer.probability(scorer.strength((r[1] or "").encode())[0]) < 0.7]
    assert Counter(map(tuple, stages["toxicity"](spark, docs, edge).collect())) == Counter(want)

    sets = [set(shingles.shingle_hashes((r[1] or "").encode(), 5, 42).tolist()) for r in rows]
    forest = Forest(len(rows))
    forest.join(*(np.array(x, int) for x in zip(*[(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])))
    groups = {}
    for r, g in zip(rows, forest.parent.tolist()):
        groups.setdefault(g, []).append(r)
    got = [tuple(r) for r in stages["simhash_near_dedup"](spark, docs, edge).collect()]
    assert len(got) == len(groups) and Counter(r[0] for r in got) == Counter(min((r[0] is None, r[0] or 0) for r in g)[1] if any(r[0] is not None for r in g) else None for g in groups.values())

    first = {}
    for i, t in sorted(((r[0] if r[0] is not None else 1 << 62), (r[1] or "").encode()) for r in rows):
        for q in range(len(t) - 49):
            first.setdefault(t[q : q + 50], i)
    want = Counter()
    for i, text, lang, source, _ in rows:
        t, me = (text or "").encode(), i if i is not None else 1 << 62
        gone = np.zeros(len(t) + 50, bool)
        for q in range(len(t) - 49):
            if first[t[q : q + 50]] < me:
                gone[q : q + 50] = True
        left = None if text is None else np.frombuffer(t, np.uint8)[~gone[: len(t)]].tobytes().decode(errors="ignore")
        want[i, left, lang, source, None if left is None else len(left)] += 1
    assert Counter(map(tuple, stages["suffix_array_dedup"](spark, docs, edge).collect())) == want

    copies = Counter()
    for r in mixing.mixed(docs).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"] * r["n"]
    got = Counter()
    for r in stages["source_mixing"](spark, docs, edge).collect():
        assert tuple(r) in rows
        got[r["doc_id"], r["source"], len((r["text"] or "").encode().split())] += 1
    assert got == Counter({k: n for k, n in copies.items() if n})
    assert stages["sentencepiece"](spark, docs, edge).count() == len(rows)


def test_labels_that_disagree(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    inside = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
    a, b, c = inside[:3]
    labels = spark.createDataFrame([(a, 1), (a, 0), (b, 1), (b, 0), (b, 0), (c, None), (77, 1), (None, 1)], "doc_id long, toxic int")
    ids, y = toxicity.training_rows(docs, labels, "toxic")
    assert dict(zip(ids.tolist(), y.tolist())) == {a: 1, b: 0}
