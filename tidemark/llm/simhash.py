"""SimHash near-duplicates: fingerprints in vantage-point trees, exact pairs within shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, hash_bucket, store, table

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that a shard is meant to hold.
SHARD = 8192
#: About so many distinct fingerprints, at most twice as many, shape the tree.
SAMPLE = 20_000
#: Texts are hashed together up to about so many bytes.
BLOCK_BYTES = 1 << 20

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_slices(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of ``data``, all slices of one length at a time; few long ones one by one."""
    out = np.empty(len(starts), np.uint64)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray((len(data) + 1,), "<u8", raw.data, strides=(1,))
    halves = np.ndarray((len(data) + 1,), "<u4", raw.data, strides=(1,))
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for size, rows in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
            if size > 96 or len(rows) < 8:
                for i in rows.tolist():
                    out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + size], seed)
                continue
            at = starts[rows]
            done = 0
            if size >= 32:
                lanes = [np.full(len(rows), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while size - done >= 32:
                    for k in range(4):
                        lanes[k] = _rotl(lanes[k] + words[at + (done + 8 * k)] * _P2, 31) * _P1
                    done += 32
                h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
                for lane in lanes:
                    h = (h ^ (_rotl(lane * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(rows), s + _P5, np.uint64)
            h += np.uint64(size)
            while size - done >= 8:
                h = _rotl(h ^ (_rotl(words[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
                done += 8
            if size - done >= 4:
                h = _rotl(h ^ (halves[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < size:
                h = _rotl(h ^ (raw[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
            out[rows] = h
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(texts: list[str | None], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, hashes) of each text with words: XXH64 of all its shingles, texts hashed together in blocks."""
    block: list[bytes] = []
    spans: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def hashed() -> Iterator[tuple[int, np.ndarray]]:
        if not spans:
            return
        hashes = xxh64_slices(b"".join(block), np.concatenate([x[1] for x in spans]), np.concatenate([x[2] for x in spans]))
        at = 0
        for i, starts, _ in spans:
            yield i, hashes[at : at + len(starts)]
            at += len(starts)

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() changes A-Z only
        if not words:
            continue
        ends = np.fromiter(accumulate(len(w) + 1 for w in words), np.int64, len(words)) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(words) - shingle + 1)
        last = ends[-1:] if len(words) < shingle else ends[shingle - 1 :]
        joined = b" ".join(words)
        block.append(joined)
        spans.append((i, starts[:n] + size, last - starts[:n]))
        size += len(joined)
        if size >= BLOCK_BYTES:
            yield from hashed()
            block.clear()
            spans.clear()
            size = 0
    yield from hashed()


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> list[int]:
    """The unsigned 64-bit fingerprint of each whole text; zero without words."""
    out = [0] * len(texts)
    for i, hashes in shingle_hashes(texts, shingle):
        out[i] = majority(hashes)
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp BIGINT): the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(fingerprints(batch.column(1).to_pylist(), shingle), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long"))


class Tree:
    """A vantage-point tree over 64-bit fingerprints, shaped by a sample.

    A node has a vantage point v and a bound t: fingerprints within t of v go
    left, the others right. By the triangle inequality, whatever lies within
    ``radius`` of x is on the left only if d(x, v) <= t + radius, and on the
    right only if d(x, v) > t - radius; all other branches are pruned.

    Where the sample gives out before a shard is small enough, drawn points
    with the bound of unrelated fingerprints part it further, so that shards
    don't grow with the input.
    """

    def __init__(self, sample: np.ndarray, total: int, shard: int, radius: int) -> None:
        self.radius = radius
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, bound, left, right; children < 0 are shards
        self.shards = 0
        self.shard = shard
        self.drawn = np.random.default_rng(SEED)
        self.root = self._grow(np.sort(sample), float(total), 0)

    def _grow(self, points: np.ndarray, total: float, depth: int) -> int:
        best = None
        if total > self.shard and len(points) <= 8 and depth < 60:
            best = (0.0, self.drawn.integers(0, 2**64, dtype=np.uint64), 31)
        elif total > self.shard and depth < 60:
            for v in points[:: max(1, len(points) // 6)][:6]:
                d = np.bitwise_count(points ^ v)
                counts = np.bincount(d, minlength=65)
                left = np.cumsum(counts) / len(points)
                for t in range(65):
                    if 0.05 <= left[t] <= 0.95:  # the fewest near the bound, the more even the better
                        near = counts[max(0, t + 1 - self.radius) : t + 1 + self.radius].sum() / len(points)
                        cost = near + 2 * abs(left[t] - 0.5)
                        if best is None or cost < best[0]:
                            best = (cost, v, t)
        if best is None:
            self.shards += 1
            return -self.shards
        _, v, t = best
        inside = np.bitwise_count(points ^ v) <= t
        at = len(self.nodes)
        self.nodes.append((int(v), t, 0, 0))
        share = inside.mean() if len(points) > 8 else 0.5
        left, right = self._grow(points[inside], total * share, depth + 1), self._grow(points[~inside], total * (1 - share), depth + 1)
        self.nodes[at] = (int(v), t, left, right)
        return at

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): each point's own shard, and the later shards that may hold neighbours.

        Of two neighbours in different shards, the one on the left at the node
        that parts them visits the other's shard, never the reverse.
        """
        rows, shards, homes = [], [], []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            at, row, home = todo.pop()
            if not len(row):
                continue
            if at < 0:
                rows.append(row)
                shards.append(np.full(len(row), -at))
                homes.append(home)
                continue
            v, t, left, right = self.nodes[at]
            d = np.bitwise_count(points[row] ^ np.uint64(v)).astype(np.int64)
            go_left = np.where(home, d <= t, d <= t + self.radius)
            go_right = d > t - self.radius
            todo.append((left, row[go_left], home[go_left]))
            todo.append((right, row[go_right], home[go_right] & (d[go_right] > t)))
        return (np.concatenate(x) if rows else np.zeros(0, np.int64) for x in (rows, shards, homes))


def local_links(fps: np.ndarray, home: np.ndarray, other: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in home, j in other) within ``radius``; branches pruned by distance to one vantage point."""
    if not len(home) or not len(other):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = fps[home[0]]
    dh, do = np.bitwise_count(fps[home] ^ v).astype(np.int64), np.bitwise_count(fps[other] ^ v).astype(np.int64)
    home, other = home[np.argsort(dh, kind="stable")], other[np.argsort(do, kind="stable")]
    dh, do = np.sort(dh), np.sort(do)
    left, right = [], []
    for s in range(0, len(home), block):
        part = home[s : s + block]
        lo, hi = np.searchsorted(do, dh[s] - radius), np.searchsorted(do, dh[min(s + block, len(home)) - 1] + radius, "right")
        for o in range(lo, hi, 4 * block):
            there = other[o : min(o + 4 * block, hi)]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[there][None, :]) <= radius)
            left.append(part[i])
            right.append(there[j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stars(n: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (left, right) among n nodes, reduced to one edge from each node to its group's node of least rank."""
    label = np.argsort(np.argsort(rank, kind="stable"), kind="stable")
    node = np.argsort(rank, kind="stable")
    while True:
        low = np.minimum(label[left], label[right])
        following = label.copy()
        np.minimum.at(following, left, low)
        np.minimum.at(following, right, low)
        following = following[node[following]]
        if (following == label).all():
            break
        label = following
    top = node[label]
    moved = np.nonzero(top != np.arange(n))[0]
    return moved, top[moved]


def near_links(distinct: DataFrame, *, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Star edges (a, b) among ``rep`` of fingerprints within ``radius``; distinct: fp, rep, both unique.

    The tree is fitted on a bounded hash sample; all fingerprints are placed
    and compared exactly. A shard that turns out larger than meant is cut into
    blocks that meet pairwise, so no task holds more than two blocks.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    step = max(1, total // sample)
    picked = distinct.where(hash_bucket(step, F.col("fp")) == 0).select("fp").toArrow().column(0).to_numpy()
    tree = Tree(picked.astype(np.int64).view(np.uint64), total, shard, radius)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            row, at, home = tree.place(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), batch.column(1).take(pa.array(row)), pa.array(at), pa.array(home)], names=["fp", "rep", "shard", "home"])

    placed = store(distinct.mapInArrow(place, "fp bigint, rep bigint, shard bigint, home boolean"), "placed")
    width = 4 * shard
    blocks = placed.groupBy("shard").agg(F.ceil(F.count("*") / width).cast("int").alias("blocks"))
    sized = placed.join(blocks, "shard").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks"))).otherwise(0).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = F.transform(others, lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    dealt = sized.select("fp", "rep", "shard", "home", "block", F.explode(met).alias("pair")).select("fp", "rep", "shard", "home", "block", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"))

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        rep, home, block = (group.column(x).to_numpy() for x in ("rep", "home", "block"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        if low == high:
            sides = [(home, np.ones(len(fp), bool))]
        else:
            sides = [(home & (block == low), block == high), (home & (block == high), (block == low) & ~home)]
        found = [local_links(fp, np.nonzero(a)[0], np.nonzero(b)[0], radius) for a, b in sides]
        left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = stars(len(fp), left, right, rep)
        return pa.table({"a": rep[a], "b": rep[b]})

    return dealt.groupBy("shard", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    docs: doc_id, text (more columns are ignored). A fingerprint bit is set if
    it is set in over half of the XXH64 hashes of the lower-cased text's word
    shingles, repeats included. Fingerprints link at ``radius`` or fewer
    differing bits; component_id is the smallest doc_id reachable by links.

    A text that is null or has no words has fingerprint zero and links like
    any other; fewer words than a shingle make one shingle. Rows with equal
    texts share one fingerprint, which is compared once, so large groups of
    copies cost no pairs. Repeated rows each return. A null doc_id gets the
    component of the other documents with its fingerprint, null if there are
    none, and links nothing. An empty table gives an empty result.
    """
    marked = store(with_fingerprints(docs, shingle), "fingerprints")
    distinct = store(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(near_links(distinct, radius=radius, shard=shard))
    resolved = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = marked.join(resolved, "fp", "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
