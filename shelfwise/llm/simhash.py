"""SimHash near-dedup by segment bit counts (operator 6).

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Two fingerprints link at
`bits` differing bits or fewer. The join embeds each distinct fingerprint as the bit counts of its segments (two bits
each, 32 in all): the Manhattan distance of two such vectors never exceeds their Hamming distance. Of the two halves of a
vector, one differs by bits // 2 at most, so each half is a grid with cells of side one and a range of that radius: a
point goes to its own cell, and points of even sum go to the adjacent cells too (for radius one, points at distance one
differ in parity, so either both share a cell or exactly one of them is even). What meets in a cell is verified by the
exact distance of the 64 bits, and each cell hands on a spanning forest of its links, not all pairs. A cell of too many
fingerprints for a task is compared as pairs of its blocks.

The operator's own way to drop near copies of documents, by five-word similarity, is in `near_copies`.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; fewer
words than a shingle make one shingle of them all; copies share a fingerprint and are joined once; component_id is the
smallest doc_id reachable (nulls last); rows that repeat get the same answer each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEGMENT = 2
SEED = 42


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """Fixed by contract: A-Z lower-cased, words between ASCII white space, shingles joined by a space, XXH64 of seed 42; repeats included."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[: n - 1]])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 20_000):
        bits = np.unpackbits(hashes[at : at + 20_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > hashes.size, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, words) for x in common.texts_of(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The bit count of each two-bit segment, packed where the segment lay."""
    ones = np.uint64(0x5555555555555555)
    return (fp & ones) + (fp >> np.uint64(1) & ones)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambling, so that cells spread evenly."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def cells(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells (as numbers) to which each point goes, and the index of its fingerprint."""
    counts = segment_counts(fp)
    out_cell, out_at = [], []
    every = np.arange(fp.size)
    for half in (0, 1):
        own = counts >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        level = [(own, every, np.full(fp.size, -1))]
        reach = [(own, every)]
        if radius == 1:
            odd = np.zeros(fp.size, np.uint64)
            for s in range(0, 32, SEGMENT):
                odd ^= own >> np.uint64(s) & np.uint64(1)
            level = [(own[odd == 0], every[odd == 0], np.full(int((odd == 0).sum()), -1))]
        for _ in range(radius):
            grown = []
            for cell, at, last in level:
                for k, s in enumerate(range(0, 32, SEGMENT)):
                    count = cell >> np.uint64(s) & np.uint64(3)
                    for up in (True, False):
                        ok = (count < 2 if up else count > 0) & (last <= k)
                        step = np.uint64(1 << s)
                        grown.append((cell[ok] + step if up else cell[ok] - step, at[ok], np.full(int(ok.sum()), k)))
            level = [tuple(np.concatenate(x) for x in zip(*grown))]
            reach.append(level[0][:2])
        cell, at = (np.concatenate(x) for x in zip(*reach))
        out_cell.append(mix(cell << np.uint64(1) | np.uint64(half)))
        out_at.append(at)
    return np.concatenate(out_cell), np.concatenate(out_at)


def forest(run: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what links of `bits` bits connect in one cell; memory in proportion to the cell."""
    label = np.arange(run.size)
    for k in range(run.size - 1):
        near = np.flatnonzero(np.bitwise_count(run[k + 1 :] ^ run[k]) <= bits) + k + 1
        if near.size and (label[near] != label[k]).any():
            met = np.unique(np.append(label[near], label[k]))
            label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(run.size))
    return run[moved], run[label[moved]]


def verify(cell: np.ndarray, fp: np.ndarray, bits: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by cell, which holds whole cells."""
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(start, cell.size))
    out = []
    own = np.repeat(np.where(size <= small, size, 0), size)
    place = np.arange(cell.size) - np.repeat(start, size)
    for step in range(1, int(own.max(initial=0))):
        a = np.flatnonzero(place + step < own)
        b = a + step
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        ok &= fp[a] != fp[b]
        out.append((fp[a[ok]], fp[b[ok]]))
    for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
        out.append(forest(np.unique(fp[s : s + n]), bits))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


#: A grid cell of more fingerprints than this is compared as pairs of blocks of half as many, in as many tasks.
MOST_IN_CELL = 4096


def parted_cells(grid: DataFrame, most: int) -> DataFrame:
    """grid (cell, fp) in which each cell of over `most` rows is replaced by a cell for each pair of its blocks.

    A block has about most / 2 rows, by a hash of the fingerprint, and goes to as many pairs as the cell has blocks. So
    every two fingerprints of a cell still meet, and no task holds more than two blocks.
    """
    hot = common.stored(grid.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most), "hot-cells")
    if not hot.limit(1).count():
        return grid
    blocks = F.ceil(2 * F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    pairs = (
        grid.join(hot, "cell").withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    )
    return grid.join(hot, "cell", "left_anti").unionByName(pairs)


def links(points: DataFrame, bits: int = 3, most: int = MOST_IN_CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that links of `bits` bits connect."""
    radius = bits // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, fp.size, 20_000):
                cell, at = cells(fp[a : a + 20_000], radius)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[a : a + 20_000][at].view(np.int64))], ["cell", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = [], []

        def out(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = verify(cell, fp, bits)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], ["a", "b"])

        for batch in batches:
            cell, fp = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "fp"))
            fp = fp.view(np.uint64)
            cut = int(np.searchsorted(cell, cell[-1])) if cell.size else 0  # the last cell may go on
            if cut:
                yield out(np.concatenate([*held_cell, cell[:cut]]), np.concatenate([*held_fp, fp[:cut]]))
                held_cell, held_fp = [], []
            held_cell.append(cell[cut:])
            held_fp.append(fp[cut:])
        if held_cell:
            yield out(np.concatenate(held_cell), np.concatenate(held_fp))

    grid = parted_cells(points.select("fp").mapInArrow(spread, "cell long, fp long"), most)
    met = grid.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long")
    return met.distinct()


def link_documents(docs: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, fingerprint (16 hex digits) and component_id."""
    marked = common.stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    points = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    roots = components(links(points, bits)).withColumnRenamed("node", "fp")
    # only fingerprints with a link have a root; the rest stand alone
    rooted = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
