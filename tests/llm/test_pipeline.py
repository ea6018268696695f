"""The pipeline against a brute-force version of every stage."""

import hashlib

import public_tokenizers
import test_decontam
import test_simhash
import tiktoken

import corpus_pipeline
from wavelens.llm import bpe, pii, simhash, toxicity
from wavelens.llm.common import table
from wavelens.llm.queries import pii_key


def test_run_matches_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    scorer = toxicity.fit_on(docs, table(spark, sf_dir, "labels")).scorer()
    kept = {i: t for i, t in rows.items() if scorer.scores([t])[0] < 0.3}
    classes = test_simhash.brute({i: simhash.fingerprint(t.encode()) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = test_decontam.brute(list(kept.items()), items)
    kept = {i: t for i, t in kept.items() if not hit[i][4]}
    texts = {r.doc_id: r.text or "" for r in pii.replace(docs.where(docs.doc_id.isin(list(kept))), pii_key(spark)).collect()}
    ranks = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 0 < len(got) < len(rows) and got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "bpe"]


def test_rows_without_an_id_or_with_a_shared_one(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").where("length(text) > 80").first().text
    rows = [(None, "an ordinary text about rivers and stones"), (None, item), (4, "another text about mountains in the north"), (4, item), (4, "another text about mountains in the north"), (5, "an ordinary text about rivers and stones"), (6, None), (7, ""), (None, "a last text that nobody else has written yet")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _row", "1 AS _own", "2 AS maybe", "3 AS bucket")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = {(4, "another text about mountains in the north"), (4, item), (5, "an ordinary text about rivers and stones"), (6, None), (None, "a last text that nobody else has written yet")}
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    got = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(str(r) for r in rows if r[1] != item)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, sf_dir).count() == 0
