"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits is cut into ``SEGMENTS``. Two fingerprints that differ in at most r bits differ in at most r div SEGMENTS bits in
one segment (Norouzi et al., 2012), so each looks up half the small Hamming ball of every one of its segments (the other half is the other's
to look up) in a table of all segments, and what it meets is verified over all 64 bits inside the join. Equal fingerprints are one row before, so copies are never paired; and
as distinct fingerprints within r bits of one are at most a constant number, links can't outgrow the fingerprints.

The pipeline's documents are compared by the Jaccard similarity of their sets of shingles. Candidates are what multi-index hashing brings together, of the fingerprints of these
sets, and, as sets at the least similarity lie far beyond its radius, what shares a MinHash key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.workers import tidied
from engrava.operators.graph import connected_components
from engrava.plans.storage import materialize, scratch

BITS, SEGMENTS = 64, 2
#: Words in a shingle and differing bits: the contract's query, and the general default.
WORDS, RADIUS = 3, 3
_AT_ONCE = 1 << 16


def _shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none without words. ASCII letters are lower-cased; fewer words than a shingle has make one shingle."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []  # splits at exactly x20 and x09-x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    starts = list(accumulate((len(t) + 1 for t in tokens[: n - 1]), initial=0))
    ends = accumulate((len(t) + 1 for t in tokens[words:]), initial=sum(map(len, tokens[:words])) + min(words, len(tokens)) - 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)


def fingerprint(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """64 bits. A bit is 1 if set in over half the hashes of the shingles, repeats included; without words all are 0."""
    return _majority(_shingle_hashes(text, words, seed))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        total += np.unpackbits(hashes[at : at + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidied(batches):
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).astype(np.int64))

    return of(text)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    return np.unique(_shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Of a set of hashes a digest of the whole, its size, ``BANDS`` keys, each of ``ROWS`` minima, ``SKETCH`` words with four bits of each minimum, and
    ``PARITY`` words of which each bit says whether an odd number of the hashes falls there; all 0 for the empty set."""
    out = np.zeros(2 + BANDS + SKETCH + PARITY, np.uint64)
    if not len(hashes):
        return out
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _MINIMA_AT_ONCE):
        np.minimum(least, (np.multiply.outer(_FACTORS, hashes[at : at + _MINIMA_AT_ONCE]) + _SHIFTS[:, None]).min(1), out=least)
    out[0], out[1] = xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes)
    out[2 : 2 + BANDS] = [xxhash.xxh64_intdigest(x.tobytes()) for x in least.reshape(BANDS, ROWS)]
    four = np.zeros(16 * SKETCH, np.uint64)
    four[: len(least)] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
    out[2 + BANDS : 2 + BANDS + SKETCH] = (four.reshape(SKETCH, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
    places = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (64 * PARITY - 1).bit_length())
    out[2 + BANDS + SKETCH :] = np.packbits(np.bincount(places.astype(np.int64), minlength=64 * PARITY).astype(np.uint8) & 1, bitorder="little").view("<u8")
    return out


def set_keys(hashes: np.ndarray) -> np.ndarray:
    """``band_keys`` and last the fingerprint of the set, in which no shingle counts twice."""
    return np.append(band_keys(hashes), np.uint64(_majority(hashes)))


def _sketch_apart(a: Column, b: Column) -> Column:
    """Minima whose four bits differ."""
    def words(k: int) -> Column:
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(lambda x, y: x + y, map(words, range(SKETCH)))


def most_apart(similarity: float, deviations: float = 4.5) -> int:
    """How many of the minima's four bits may differ between two sets of this similarity: more do with a probability of 3e-6."""
    n, differ = BANDS * ROWS, (1 - similarity) * 15 / 16
    return math.floor(n * differ + deviations * math.sqrt(n * differ * (1 - differ)))


def _longs(text: Column, of: Callable[[str | None], np.ndarray]) -> Column:
    @F.pandas_udf("array<long>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidied(batches):
            yield pd.Series([of(t).view(np.int64) for t in texts])

    return each(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_reach(segments: int, radius: int) -> list[int]:
    """How far each segment is searched so that no pair within ``radius`` is missed: with r = q * segments + a, the first a + 1 segments to q,
    the others to q - 1 (-1: not at all)."""
    q, a = divmod(radius, segments)
    return [q if s <= a else q - 1 for s in range(segments)]


def _ball(word: Column, seg: int, lo: int, hi: int, reach: int) -> list[Column]:
    """The keys that a segment (bits lo to hi of a word) looks up: itself and, of its Hamming ball, what has a 1 in the highest place that differs. Of two
    segments the one with the 0 there finds the other."""
    own = word.bitwiseAND(F.lit(_signed(((1 << hi) - 1) ^ ((1 << lo) - 1))))
    flips = [(_signed(sum(1 << b for b in c)), _signed(1 << max(c))) for n in range(1, reach + 1) for c in combinations(range(lo, hi), n)]
    out = [F.array(F.struct(F.lit(seg).alias("seg"), own.alias("key")))] if reach >= 0 else []
    if flips:
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(h).alias("h")) for f, h in flips])
        up = F.filter(pairs, lambda p: own.bitwiseAND(p["h"]) == 0)
        out.append(F.transform(up, lambda p: F.struct(F.lit(seg).alias("seg"), own.bitwiseXOR(p["f"]).alias("key"))))
    return out


def _places(words: list[str], segments: int, reach: list[int]) -> list[tuple[str, int, int, int, int]]:
    """Of each segment its word, number, first and last bit, and reach."""
    return [(w, j * segments + k, k * BITS // segments, (k + 1) * BITS // segments, reach[k]) for j, w in enumerate(words) for k in range(segments)]


def _at_segments(prints: DataFrame, keys: Column, columns: list[str], prefix: str) -> DataFrame:
    named = [f"{prefix}{c}" for c in columns]
    return prints.select(*columns, F.explode(keys).alias("x")).toDF(*named, "x").select(*named, "x.seg", "x.key")


def _own_keys(places: list[tuple[str, int, int, int, int]]) -> Column:
    own = lambda w, lo, hi: F.col(w).bitwiseAND(F.lit(_signed(((1 << hi) - 1) ^ ((1 << lo) - 1))))
    return F.array(*[F.struct(F.lit(s).alias("seg"), own(w, lo, hi).alias("key")) for w, s, lo, hi, r in places if r >= 0])


def _differ(words: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in words])


def links(prints: DataFrame, words: list[str], segments: int, reach: list[int], most: int, apart: str = "node", indexed: int | None = None) -> DataFrame:
    """``src, dst``: pairs of ``node`` whose first ``indexed`` ``words`` (columns of 64 bits, each cut into ``segments``) come within ``reach`` in some segment, that differ in
    at most ``most`` bits of all words, and that aren't equal in ``apart``. A pair may come more than once and in either order. Distances are compared inside the join, which
    is a merge join at every size: AQE splits keys that many share."""
    places = _places(words[:indexed], segments, reach)
    columns = list(dict.fromkeys(["node", *words, apart]))
    # Where rows carry more than themselves, each segment's index is made in a pass of its own: a fingerprint's rows then never lie together, at any number of partitions.
    passes = [places] if len(columns) == 1 else [[p] for p in places]
    balls = [F.concat(*[x for w, s, lo, hi, r in part for x in _ball(F.col(w), s, lo, hi, r)]) for part in passes]
    a = reduce(DataFrame.union, [_at_segments(prints, ball, columns, "a") for ball in balls])
    b = reduce(DataFrame.union, [_at_segments(prints, _own_keys(part), columns, "b") for part in passes])
    met = a.join(b.hint("merge"), ["seg", "key"]).where((F.col(f"a{apart}") != F.col(f"b{apart}")) & (_differ(words, "a", "b") <= most))
    return met.select(F.col("anode").alias("src"), F.col("bnode").alias("dst"))


def group_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component_id`` for ``nodes`` (``node, rep``): the smallest ``rep`` reachable by links."""
    parts = connected_components(edges)
    reps = parts.join(nodes.select("node", "rep"), "node")
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    found = reps.join(least, "component").select("node", "least")
    return nodes.select("node", "rep").join(found, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row: ``doc_id, fp, component_id``; ``fp`` is the fingerprint as a signed long.

    Null and empty texts have fingerprint 0 and are linked by it like any other. A null doc_id never is a component's smallest, unless
    there are none but nulls. Rows of one doc_id stay apart. An empty table gives no rows; extra columns are ignored.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long"), fingerprints(F.col("text"), words).alias("fp")), "fingerprints")
    nodes = materialize(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    groups = materialize(group_nodes(nodes, links(nodes, ["node"], SEGMENTS, segment_reach(SEGMENTS, radius), radius)), "groups")
    return rows.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", "component_id")


#: For similarity of texts: of each set of shingles so many keys of so many minima. Two sets at 0.8 share none with a probability of (1 - 0.8 ** ROWS) ** BANDS, 1e-5.
BANDS, ROWS = 38, 6
SKETCH, PARITY = -(-BANDS * ROWS // 16), 16
_MINIMA_AT_ONCE = 512
_FACTORS, _SHIFTS = np.random.default_rng(1997).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)
#: Bytes of bitmaps up to which they are broadcast: half a billion documents.
BITMAP_BYTES = 64 << 20


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``src, dst`` those whose sets (``node, hashes``) have at least this Jaccard similarity. Merge joins at every size: AQE splits a node that many pairs share."""
    both = pairs.join(sets.toDF("src", "x").hint("merge"), "src").join(sets.toDF("dst", "y").hint("merge"), "dst")
    common = both.select("src", "dst", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    return common.where(F.col("common") >= F.lit(similarity) * (F.col("n") - F.col("common")) - 1e-9).select("src", "dst")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``src, dst``: fingerprints (``print`` of ``nodes``, signed longs) within ``RADIUS`` of each other, each pair once. Found by multi-index hashing as in ``near_duplicates``."""
    found = links(nodes.select(F.col("print").alias("node")).distinct(), ["node"], SEGMENTS, segment_reach(SEGMENTS, RADIUS), RADIUS)
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def fingerprint_stars(nodes: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """``src, dst`` of nodes (``node, print``): each with the smallest of its group, of those connected by ``fingerprint_links`` (``met``, if they are known);
    a row for each node at most, however large a group is."""
    prints = materialize(nodes.groupBy("print").agg(F.min("node").alias("rep")).select(F.col("print").alias("node"), "rep"), "set-fingerprints")
    groups = materialize(group_nodes(prints, fingerprint_links(nodes) if met is None else met), "fingerprint-groups")
    met = nodes.select("print", F.col("node").alias("dst")).join(groups.select(F.col("node").alias("print"), F.col("component_id").alias("src")).hint("merge"), "print")
    return met.where("src <> dst").select("src", "dst")


def fingerprint_rest(held: DataFrame, met: DataFrame, alike: Callable[[str, str], Column]) -> DataFrame:
    """``src, dst`` of nodes (``held``: ``node, print, grp`` and what ``alike`` reads) in different ``grp`` whose fingerprints are equal or linked (``met``): every such pair for which ``alike``,
    of the names of both sides' columns, holds inside the join. Fingerprints that have one ``grp`` between them aren't joined."""
    of = materialize(held.groupBy("print").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")), "groups-of-fingerprints")
    both = met.join(of.toDF("src", "lo", "hi").hint("merge"), "src").join(of.toDF("dst", "lo_dst", "hi_dst").hint("merge"), "dst")
    mixed = both.where(F.least("lo", "lo_dst") != F.greatest("hi", "hi_dst")).select("src", "dst")
    mixed = materialize(mixed.union(of.where("lo <> hi").select(F.col("print").alias("src"), F.col("print").alias("dst"))), "mixed-fingerprints")
    a, b = (held.select(*[F.col(c).alias(f"{c}_{x}") for c in held.columns]) for x in ("src", "dst"))
    one = materialize(mixed.join(a.hint("merge"), F.col("src") == F.col("print_src")).drop("src"), "fingerprint-sides")
    once = (F.col("dst") != F.col("print_src")) | (F.col("node_src") < F.col("node_dst"))
    pairs = one.join(b.hint("merge"), F.col("dst") == F.col("print_dst")).where(once & (F.col("grp_src") != F.col("grp_dst")) & alike("src", "dst"))
    return pairs.select(F.least("node_src", "node_dst").alias("src"), F.greatest("node_src", "node_dst").alias("dst"))


def similar_documents(tagged: DataFrame, text: str, rank: Column, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``_row`` of one row of ``tagged`` (with ``_keys``, its ``set_keys``) for each group: the one with the smallest ``rank``.

    Groups are what is connected by pairs whose sets of shingles have this Jaccard similarity. Equal sets are one node. Candidates are brought together by
    multi-index hashing of their fingerprints, or share a key of minima and have sizes that allow the similarity; each is verified by the sets themselves, which are made for nodes with a candidate only. First
    each node of a key, or of a group by fingerprints, is held against the smallest one, then pairs of a key, and of fingerprints that are equal or linked, that this hasn't brought together, so a large group
    of near copies is not paired; of these, the join itself leaves out those whose sketches are too far apart: sets of this similarity differ in few members, and in no more bits of parity.
    """
    with scratch(tagged.sparkSession):
        nodes = tagged.groupBy("_keys").agg(F.min(rank).alias("rep"))
        nodes = materialize(nodes.select(F.col("rep.row").alias("node"), "rep", F.col("_keys")[1].alias("size"), F.slice("_keys", 3, BANDS).alias("keys"), F.slice("_keys", 3 + BANDS, SKETCH + PARITY).alias("sketch"), F.element_at("_keys", -1).alias("print")), "shingle-sets")
        rows = nodes.where("size > 0").select("node", "size", F.posexplode("keys").alias("band", "key"))
        hubs = rows.groupBy("band", "key").agg(F.min(F.struct("node", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
        hubs = materialize(hubs, "hubs")  # so that the join below shuffles both sides, and AQE can split a key
        met = materialize(rows.join(hubs.hint("merge"), ["band", "key"]), "met")
        fit = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9
        linked = materialize(fingerprint_links(nodes.where("size > 0")), "fingerprint-links")
        near = materialize(fingerprint_stars(nodes.where("size > 0"), linked), "fingerprint-stars")
        candidates = met.select("node").union(near.select("src")).union(near.select("dst")).distinct()
        sets = _keep_rows(tagged, materialize(candidates.select(F.col("node").alias("_row")), "candidates"))
        sets = materialize(sets.select(F.col("_row").alias("node"), _longs(F.col(text), lambda t: shingle_set(t, words)).alias("hashes")), "sets")
        first = met.where((F.col("node") != F.col("hub.node")) & fit(F.col("size"), F.col("hub.size"))).select(F.col("hub.node").alias("src"), F.col("node").alias("dst")).union(near).distinct()
        stars = materialize(_alike(first, sets, similarity), "stars")
        groups = connected_components(stars).select("node", F.col("component").alias("grp"))
        grouped = met.drop("hub").join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        mixed = grouped.groupBy("band", "key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("band", "key")
        mixed = materialize(mixed, "mixed")
        grouped = materialize(grouped.join(mixed.hint("merge"), ["band", "key"], "left_semi").join(nodes.select("node", "sketch"), "node"), "grouped")
        a, b = (grouped.select("band", "key", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "grp", "sketch")]) for x in ("src", "dst"))

        def can_be_alike(x: str, y: str) -> Column:
            """By the sizes and the bits of parity: exact."""
            differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"sketch_{x}")[k].bitwiseXOR(F.col(f"sketch_{y}")[k])) for k in range(SKETCH, SKETCH + PARITY)])
            sizes = (F.col(f"size_{x}"), F.col(f"size_{y}"))
            return fit(*sizes) & (differ <= F.lit((1 - similarity) / (1 + similarity)) * (sizes[0] + sizes[1]) + 1e-9)

        apart = (F.col("src") < F.col("dst")) & (F.col("grp_src") != F.col("grp_dst")) & can_be_alike("src", "dst")
        rest = a.join(b.hint("merge"), ["band", "key"]).where(apart & (_sketch_apart(F.col("sketch_src"), F.col("sketch_dst")) <= most_apart(similarity))).select("src", "dst")
        held = near.select("src").union(near.select("dst")).distinct().toDF("node").join(nodes.select("node", "size", "sketch", "print"), "node").join(groups, "node", "left")
        held = materialize(held.withColumn("grp", F.coalesce("grp", "node")), "fingerprint-nodes")
        rest = rest.union(fingerprint_rest(held, linked, can_be_alike)).distinct()
        kept = group_nodes(nodes, stars.union(materialize(_alike(rest, sets, similarity), "alike"))).select(F.col("component_id.row").alias("_row")).distinct()
        return materialize(kept, "kept", keep=True)


def _keep_rows(tagged: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``tagged`` whose ``_row`` is in ``kept``, by one bit for each document: broadcast as long as these are few, else a merge join moves the rows."""
    bits = kept.groupBy(F.bitmap_bucket_number("_row").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("_bits"))
    bits = materialize(bits, "kept-bits")
    if bits.count() * 4096 > BITMAP_BYTES:
        return tagged.join(kept.hint("merge"), "_row", "left_semi")
    at = F.bitmap_bit_position("_row")
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = tagged.withColumn("_bucket", F.bitmap_bucket_number("_row")).join(F.broadcast(bits), "_bucket")
    return held.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)


def dedup_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of similar ones: the one with the smallest doc_id (nulls last; of rows with one doc_id the first in the input).

    All columns stay, whatever their names. Null and empty texts are one group. The texts are read for their keys and written once with
    a row number, by which the kept rows are found, and aren't shuffled as long as one bit for each can be broadcast.
    """
    cols = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(cols))])
    doc_id, text = (f"c{cols.index(c)}" for c in ("doc_id", "text"))
    tagged = materialize(inner.withColumn("_keys", _longs(F.col(text), lambda t: set_keys(shingle_set(t, words)))).withColumn("_row", F.monotonically_increasing_id()), "tagged")
    rank = F.struct(F.col(doc_id).isNull().alias("late"), F.col(doc_id).cast("long").alias("doc_id"), F.col("_row").alias("row"))
    kept = similar_documents(tagged, text, rank, words, similarity)
    out = _keep_rows(tagged, kept).select(*[f"c{k}" for k in range(len(cols))])
    return out.toDF(*cols)


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
