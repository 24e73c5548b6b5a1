"""The manifest against a tree built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from engrava.llm import merkle
from tests.llm.helpers import SF, awkward, clashing, docs_of

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [*(row[c] for c in FIELDS[:-1]), text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root, and for each node what stands left and right of it at each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
        at = [i // 8 for i in at]
        level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    trees, out = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted(groups[lang], key=lambda m: m[:3])
        trees.append((members, *climb([m[2] for m in members])))
    root, above = climb([t[1] for t in trees])
    for (members, subroot, paths), up in zip(trees, above):
        for (_, _, leaf, r), path in zip(members, paths):
            path = path + up
            fold = leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                fold = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
            for left, right in path:
                fold = sha(*left, fold, *right)
            out.append((r.doc_id, leaf, subroot, root, sha(*(x for left, right in path for x in left + right)), fold, fold == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def same(got, rows):
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_awkward_tables(spark):
    df = awkward(spark)
    # Null ids and repeated rows stand by digest, whose order is the brute force's too.
    same(merkle.verify_documents(df), df.collect())
    same(merkle.verify_documents(clashing(spark, df)), df.collect())
    assert merkle.verify_documents(docs_of(spark, [])).count() == 0
    same(merkle.verify_documents(docs_of(spark, [(3, "One")])), docs_of(spark, [(3, "One")]).collect())


@pytest.mark.parametrize("n", [8, 9, 64, 65, 521])
def test_sizes_around_the_fan(spark, n):
    df = docs_of(spark, [(k * 7 % n, f"Text {k}", "en" if k % 5 else None, "s") for k in range(n)])
    same(merkle.verify_documents(df.repartition(3)), df.collect())


def test_many_groups_and_a_hot_one(spark):
    df = docs_of(spark, [(k, f"T{k}", f"l{k % 150}" if k % 3 else "é", None) for k in range(700)])
    same(merkle.verify_documents(df.repartition(5)), df.collect())


def test_equal_rows_fall_into_several_runs(spark):
    df = spark.range(5000).select(F.lit("en").alias("grp"), F.lit(1).cast("long").alias("key"), F.lit("ab").alias("leaf"), F.lit(None).cast("string").alias("claimed"))
    placed = merkle._numbered(df)
    assert [r.pos for r in placed.orderBy("pos").collect()] == list(range(5000))


def test_store_is_by_level(spark, tmp_path):
    leaves = merkle.document_leaves(spark.read.parquet(f"{SF}/documents.parquet"))
    manifest = merkle.build_manifest(leaves, f"file://{tmp_path}/m")
    nodes = spark.read.parquet(f"file://{tmp_path}/m/rows").groupBy("level").count()
    counts = {r["level"]: r["count"] for r in nodes.collect()}
    assert len(counts) == len(manifest.levels) > 2 and all(counts[k + 1] < counts[k] for k in range(len(counts) - 1))


def test_query_on_whole_table(spark):
    same(merkle.op12_node_store(spark, SF), spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_main_path_is_native(spark):
    plan = merkle.op12_node_store(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
