import numpy as np

import corpus_pipeline
from engrava.llm import mixing
from engrava.llm.quality import THRESHOLD, fit_quality
from engrava.llm.simhash import shingle_set
from engrava.plans.storage import materialize
from tests.llm.helpers import SF, awkward, clashing, components, docs_of
from tests.llm.test_packing import check
from tests.llm.test_tokens import plain


def kept_by_brute_force(docs):
    """The smallest doc_id of each group of documents whose sets of five-word shingles are connected by similarities of 0.8 or more."""
    rows = [(r.doc_id, set(shingle_set(r.text, 5).tolist())) for r in docs.collect()]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (u := len(rows[a][1] | rows[b][1])) == 0 or len(rows[a][1] & rows[b][1]) >= 0.8 * u - 1e-9]
    least = {}
    for (doc_id, _), root in zip(rows, components(len(rows), pairs)):
        least[root] = min(least.get(root, doc_id), doc_id)
    return sorted(least.values())


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        texts = {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in before.collect()}
        after = [tuple(r) for r in docs.collect()]
        assert after and set(after) <= texts
        if name == "language":
            assert not any(r[1] is None for r in after) and len(after) >= 0.98 * len(texts)
        if name == "near_duplicates":
            assert len({r[1] for r in after}) == len(after)
            assert min(r[0] for r in after) == min(r[0] for r in texts)
            assert sorted(r[0] for r in after) == kept_by_brute_force(before)
        if name == "quality":
            model = fit_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert sorted(r[0] for r in after) == sorted(r.doc_id for r in before.collect() if model.score([r.text])[0] >= THRESHOLD)
        if name == "mixture":
            assert sum(len((r[1] or "").encode().split()) for r in after) == sum(r.taken for r in mixing.mix_sources(before).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    n, least = check([(r.doc_id, r.text) for r in docs.collect()], packed, plain("byte_bpe_50k")[1])
    assert n <= least * 1.01 + 1


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_awkward_documents(spark):
    for docs in (clashing(spark, awkward(spark)), docs_of(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0
            if name != "sequences":
                assert out.columns == docs.columns


def test_language_rejects_what_is_like_no_language_of_the_sample(spark):
    rng = np.random.default_rng(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由，在尊严和权利上一律平等。",
        *[" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(60)) for _ in range(10)],
    ]
    added = docs_of(spark, [(10**9 + k, x, None) for k, x in enumerate(strange)]).select(docs.columns)
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(added), SF).collect()]
    assert max(kept) < 10**9
    assert len(kept) >= 0.98 * docs.where(docs.text.rlike(r"\p{L}")).count()
