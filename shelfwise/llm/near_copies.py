"""Near copies of documents by SimHash and exact five-word similarity: how operator 6 drops them in the pipeline.

Texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come from
the SimHash fingerprints of these shingles, joined on the grid of segment bit counts (`simhash.links`). At 0.8 the
fingerprints of two texts differ in 9.7 of 64 bits on average, and a grid over that many bits no longer parts texts, so the
join keeps its three bits, and pairs further apart become candidates by bands of minima of the same shingle hashes (24 of
five: a pair at 0.8 shares none with a probability of 0.00007, one at 0.9 practically never). A group is what
shares a fingerprint or a band; fingerprints that link propose their pair.

The sets themselves decide. First every member of a group is held against its smallest member: as many comparisons as
members. Groups that this leaves in more than one component have all their pairs compared, but for pairs already in one
component: in blocks of at most `BLOCK_BYTES` of sets, two of which meet in a task, however large the group. A component is
what pairs of similarity 0.8 or more connect.

Defined cases: A-Z is lower-cased, words are what ASCII white space parts; fewer words than five make one shingle of them
all, and texts without words are equal; equal sets are one text; a set is known by 64 bits, a shingle too; of a component
the row of the smallest id stays (nulls last), then of the smallest text digest; rows that repeat id and text are one;
an empty table gives an empty result; all columns come back, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

BANDS, ROWS = 24, 5
#: Similarity of near copies: 4 / 5, as a fraction so that counts decide exactly.
NUMERATOR, DENOMINATOR = 4, 5
#: Differing bits at which fingerprints propose a pair.
BITS = 3
#: Sets of one block, in bytes.
BLOCK_BYTES = 16_000_000
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
_XOR, _TIMES, _FOLD = _DRAWN[0][:, None], _DRAWN[1][:, None] | np.uint64(1), (_DRAWN[2] | np.uint64(1)).reshape(BANDS, ROWS)
#: The set of a text without words.
_NONE = np.array([xxhash.xxh64_intdigest(b"", simhash.SEED)], np.uint64)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The distinct shingles as sorted XXH64 values."""
    hashes = np.unique(simhash.shingle_hashes(text, words))
    return hashes if hashes.size else _NONE


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, hashes.size, 4096):
        least = np.minimum(least, ((hashes[a : a + 4096] ^ _XOR) * _TIMES).min(axis=1))
    key = ((least ^ least >> np.uint64(31)).reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return key ^ key >> np.uint64(29)


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b elements with so many shared ones have a Jaccard similarity of 4 / 5 or more."""
    return shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (a + b)


def linked(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Places (a, b) of similar sets that connect components; sets of one label are connected beforehand and aren't compared."""
    sizes = np.array([s.size for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark, comp = np.zeros(int(flat.max()) + 1, bool), np.unique(label, return_inverse=True)[1]
    out = []
    for at in range(len(sets) - 1):
        # beyond these sizes no pair can be similar
        open_ = (comp[at + 1 :] != comp[at]) & similar(np.minimum(sizes[at + 1 :], sizes[at]), sizes[at + 1 :], sizes[at])
        if not open_.any():
            continue
        own, first = flat[starts[at] : ends[at]], starts[at + 1]
        mark[own] = True
        shared = np.add.reduceat(mark[flat[first:]], starts[at + 1 :] - first, dtype=np.int64)
        mark[own] = False
        for k in (np.flatnonzero(open_ & similar(shared, sizes[at + 1 :], sizes[at])) + at + 1).tolist():
            if comp[k] != comp[at]:
                comp[comp == comp[k]] = comp[at]
                out.append((at, k))
    return out


def marks(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, sid, fp, keys): the id of each text's set, its SimHash fingerprint and its bands."""
    names = ["doc_id", "digest", "sid", "fp", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, prints, keys = [], [], []
            for x in common.texts_of(batch["text"]):
                hashes = simhash.shingle_hashes(x, words)
                prints.append(simhash.majority(hashes))
                own = np.unique(hashes) if hashes.size else _NONE
                sids.append(set_id(own))
                keys.append(bands(own))
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, BANDS, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sids, prints)), lists], names)

    plain = common.id_and_text(docs, id_col, text_col).withColumn("digest", common.text_digest("text"))
    return plain.mapInArrow(run, "doc_id long, digest long, sid long, fp long, keys array<long>")


def candidate_groups(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, sid) of what shares a band or a fingerprint, and (key, centre) of its groups of two or more; of groups with the same members one is kept."""
    by_print = points.select(F.xxhash64(F.lit("fingerprint"), "fp").alias("key"), "sid")
    members = common.stored(by_print.unionByName(points.select(F.explode("keys").alias("key"), "sid")), "members")
    held = members.groupBy("key").agg(F.min("sid").alias("centre"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("which")).filter("n > 1")
    return members, common.stored(held.groupBy("centre", "n", "which").agg(F.min("key").alias("key")).select("key", "centre"), "groups")


def pairs_by_print(points: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that the fingerprints' links propose: of each fingerprint the smallest set."""
    prints = points.groupBy("fp").agg(F.min("sid").alias("sid"))
    edges = simhash.links(prints, BITS)
    a, b = (prints.select(F.col("fp").alias(fp), F.col("sid").alias(sid)) for fp, sid in (("a", "sid_a"), ("b", "sid_b")))
    return edges.join(a, "a").join(b, "b").select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b"))


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*([np.frombuffer(x, np.uint64) for x in batch[c].to_pylist()] for c in ("a_set", "b_set")))
            good = [similar(np.intersect1d(x, y, True).size, x.size, y.size) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    a, b = (sets.select(F.col("sid").alias(c), F.col("hashes").alias(f"{c}_set"), F.col("n").alias(f"{c}_n")) for c in ("a", "b"))
    joined = pairs.join(a, "a").join(b, "b").filter(F.least("a_n", "b_n") * DENOMINATOR >= F.greatest("a_n", "b_n") * NUMERATOR)
    return joined.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def links_within(rows: DataFrame) -> DataFrame:
    """Links among rows (meeting, label, hashes) of one meeting, as pairs (a, b) of labels; a task holds one meeting at a time."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        label = table["label"].to_numpy()
        found = linked([np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()], label)
        a, b = (label[np.array([p[k] for p in found], np.int64)] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch["meeting"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), keys.size]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and held and held[0]["meeting"][0].as_py() != keys[a]:
                    yield settle(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield settle(held)

    return rows.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "a long, b long")


def decide(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row doc_id, digest and root: the same root for what links connect."""
    marked = common.stored(marks(docs, words, id_col, text_col), "marks")
    points = common.stored(marked.groupBy("sid").agg(F.first("keys").alias("keys"), F.min("fp").alias("fp"), F.min("digest").alias("digest")), "points")
    members, groups = candidate_groups(points)
    grouped = members.join(groups, "key")
    with_centre = grouped.filter("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b"))
    pairs = common.stored(with_centre.unionByName(pairs_by_print(points)).distinct(), "pairs")

    # the sets of all that have company: one text of each, found by its digest; stored, so that Spark knows its size before it shuffles texts
    named = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(points.select("sid", "digest"), "sid"), "named")
    asked = common.id_and_text(docs, id_col, text_col).withColumn("digest", common.text_digest("text"))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, words) for x in common.texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["sid"], pa.array([s.tobytes() for s in found], pa.binary()), pa.array([s.size for s in found], pa.int64())], ["sid", "hashes", "n"])

    one = asked.select("digest", "text").join(named, "digest").dropDuplicates(["digest"]).select("sid", "text")
    sets = common.stored(one.mapInArrow(with_sets, "sid long, hashes binary, n long"), "sets")

    near = common.stored(similar_pairs(pairs, sets), "near")
    labels = components(near)
    placed = grouped.select("key", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("label"))
    placed = common.stored(placed, "placed")
    apart = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    open_ = placed.join(apart, "key").join(sets, "sid")
    blocks = open_.groupBy("key").agg(F.ceil(F.sum(F.col("n") * 8) / block_bytes).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
    meetings = (
        open_.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), "label", "hashes")
    )
    within = common.stored(links_within(meetings).distinct(), "within")
    # what these links connect are components of labels
    joined = components(within).select(F.col("node").alias("label"), F.col("root").alias("over"))
    placed_sets = labels.select(F.col("node").alias("sid"), F.col("root").alias("label"))
    roots = marked.join(placed_sets, "sid", "left").withColumn("label", F.coalesce("label", "sid")).join(joined, "label", "left")
    decided = common.stored(roots.select("doc_id", "digest", F.coalesce("over", "label").alias("root")), "decided")
    common.forget(marked, points, members, groups, pairs, named, sets, near, placed, within)
    return decided


def keep_least(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each root of `decided` (doc_id, digest, root): the smallest id's (nulls last), then the smallest digest's.

    A row is named by its id and its text's digest (`common.text_digest`), so rows of one id, or of none, are decided apart.
    """
    names = decided.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    gone = decided.join(names, "root").filter(~stays).select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__gone_digest")).distinct()
    gone = common.stored(gone, "gone")  # Spark knows its size before it shuffles texts
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that no column's name can clash
    at, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    kept = own.join(gone, at.cast("long").eqNullSafe(F.col("__gone")) & (digest == F.col("__gone_digest")), "left_anti")
    twice = decided.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    if twice:
        kept = kept.withColumn("digest", digest).dropDuplicates([f"c{docs.columns.index(id_col)}", "digest"]).drop("digest")
    return kept.toDF(*docs.columns)


def drop(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component; all columns as they were."""
    return keep_least(docs, decide(docs, words, id_col, text_col), id_col, text_col)
