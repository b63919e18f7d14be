"""The pipeline over the smallest table, each stage against what it must keep, and over odd rows."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_edge_cases import DOCS, rows
from veilgraph.llm import byte_bpe, quality_rules, secret_scan
from veilgraph.llm.common import written

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "secret_scans", "mixing", "byte_level_bpe"]
    clean = written(stages["quality_rules"](spark, docs, SF), "t1")
    kept = {r.doc_id for r in quality_rules.judge_quality(docs).where("kept").collect()}
    assert {r.doc_id for r in clean.collect()} == kept and clean.columns == docs.columns

    texts = {r.doc_id: r.text for r in clean.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    groups = defaultdict(list)
    for i in ids:
        groups[top(i)].append(i)
    single = written(stages["simhash_near_dedup"](spark, clean, SF), "t2")
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups.values())

    told = written(stages["secret_scans"](spark, single, SF), "t3")
    found = {r.doc_id: r for r in secret_scan.find_secrets(single).collect()}
    for r in told.collect():
        spans = [s for kind in ("assign", "access", "hex", "random") for s in found[r.doc_id][kind]]
        assert (r.text == texts[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        assert not any(s.hit in r.text for s in spans)

    mixed = written(stages["mixing"](spark, told, SF), "t4")
    before, after = ({r.doc_id: len(r.text.split()) for r in d.collect()} for d in (told, mixed))
    assert set(after) <= set(before) and 0.8 * sum(before.values()) <= sum(after.values()) <= 0.9 * sum(before.values())

    enc = byte_bpe.encoding(byte_bpe.read_vocabulary())
    last = {r.doc_id: r for r in stages["byte_level_bpe"](spark, mixed, SF).collect()}
    for r in mixed.collect():
        ids_ = enc.encode_ordinary(r.text)
        assert last[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest()
        assert last[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_stages_take_odd_and_no_rows(spark):
    odd = spark.createDataFrame(rows(), DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = written(stage(spark, odd, SF), f"odd-{name}")
        assert [c.split()[0] for c in DOCS.split(", ")] == odd.columns and odd.count() > 0
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
