"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. Texts are dealt into blocks. Every block lists its distinct shingles (runs of
   five words) with the number of its documents that hold each, packed by range
   of the hash; document frequencies are added up per range over all documents.
   A shingle that is everywhere has one entry per block.
2. Shingles held by two or more documents go back to their blocks. A text can be
   0.8 similar to another only if such shingles have 0.8 of its weight; those
   texts get samples over them, which can only make similar texts meet more often.
3. Texts meet in buckets of banded samples. Every member is compared with the
   bucket's centre by exact weighted Jaccard similarity. Further rounds, with
   another centre in every bucket, compare what is still in different classes.
   Texts of buckets that still hold different classes are then joined by the
   rarest of their shingles: two texts that reach the similarity share one of
   them, and from the first one on either still has the weight that they must
   share, so no two of these texts stay uncompared that could be linked.
4. Classes are connected components of the links, found by alternating star steps.

Exact copies share a digest and are never compared.

The weight of a shingle is its count times 1 + RARITY ln(N / df) / ln(N): common
shingles weigh less, but so little that the similarity stays near the plain one.

Defined cases: a null text is a class of its own; empty texts are copies of each
other; a text of one to four words is one shingle; null doc_ids take part but do
not name a class unless all its ids are null; an empty table gives an empty
result; repeated rows are copies; further columns are ignored by `classes` and
pass through `keep_one` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import emptied, release, settle, ship, slices
from skyledger.llm.words import SPACED, mix, shingle_hashes, word_hashes

SIZE = 5
BANDS, ROWS = 16, 3
#: A round that links fewer than one in so many of its pairs is the last; what is apart then is joined by shingles.
FEW_LINKS = 20
#: How much more the rarest shingle weighs than the commonest.
RARITY = 0.25
_KEY_BYTES = 5
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND_FACTORS = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)


def _block_shingles(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row of the frame) of every shingle of every whole text."""
    hashes, rows, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part, texts in slices(frame):
        found, offsets = shingle_hashes(*word_hashes(texts, SPACED), SIZE)
        hashes.append(found)
        rows.append(np.repeat(np.arange(len(part)) + at, np.diff(offsets)))
        at += len(part)
    return np.concatenate(hashes), np.concatenate(rows)


def _sorted_pairs(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) pairs by hash, with their counts."""
    order = np.argsort(hashes, kind="stable")
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if h.size else np.zeros(0, np.int64)
    return h[first], r[first], np.diff(np.append(first, h.size))


def _ranges(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket's hashes: the bucket is a range of the upper 32 bits."""
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _pack(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _count_blocks(placed: DataFrame, buckets: int) -> DataFrame:
    """Packed rows (bucket, block, keys, repeated, counts): each block's distinct shingles."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        h, _, _ = _sorted_pairs(*_block_shingles(frame))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, np.int64)
        distinct, docs = h[first], np.diff(np.append(first, h.size))
        bounds, out = _ranges(distinct, buckets), []
        for b in range(buckets):
            low, high = bounds[b], bounds[b + 1]
            if high > low:
                many = np.flatnonzero(docs[low:high] > 1)
                out.append((b, key[0], _pack(distinct[low:high], _KEY_BYTES), _pack(many, 4), _pack(docs[low:high][many], 4)))
        return pd.DataFrame(out, columns=["bucket", "block", "keys", "repeated", "counts"])

    return placed.groupBy("block").applyInPandas(run, "bucket int, block int, keys binary, repeated binary, counts binary")


def _shared(counted: DataFrame) -> DataFrame:
    """Packed rows (block, bucket, places, dfs): the shingles that two or more documents hold."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, docs, sizes = [], [], []
        for packed, repeated, counts in zip(frame["keys"], frame["repeated"], frame["counts"]):
            own = _unpack(packed, _KEY_BYTES)
            n = np.ones(own.size, np.int64)
            n[_unpack(repeated, 4).astype(np.int64)] = _unpack(counts, 4).astype(np.int64)
            keys.append(own), docs.append(n), sizes.append(own.size)
        joined, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(joined, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(joined[order]) != 0]))
        total = np.add.reduceat(docs[order], first)
        df = np.empty(joined.size, np.int64)
        df[order] = np.repeat(total, np.diff(np.append(first, joined.size)))
        out = []
        for block, own in zip(frame["block"], np.split(df, np.cumsum(sizes)[:-1])):
            at = np.flatnonzero(own > 1)
            if at.size:
                out.append((block, key[0], _pack(at, 4), _pack(own[at], 5)))
        return pd.DataFrame(out, columns=["block", "bucket", "places", "dfs"])

    return counted.groupBy("bucket").applyInPandas(run, "block int, bucket int, places binary, dfs binary")


def samples(hashes: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Band keys (sets x BANDS) of weighted sets laid end to end; ``begins`` are their first places.

    For each hash function, element k with weight w has r and c from Gamma(2, 1)
    and b from (0, 1), all drawn from the hash of k; t = floor(ln w / r + b), and
    the sample is the (k, t) with the least ln c - r (t - b) - r.
    """
    unit = lambda x: (x.astype(np.float64) + 0.5) * 2.0**-32
    low = np.uint64(0xFFFFFFFF)
    ends = np.append(begins[1:], hashes.size)
    owner = np.repeat(np.arange(begins.size), ends - begins)
    log_w = np.log(weights)
    keys = np.zeros((begins.size, BANDS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        x = mix(hashes ^ seed)
        y = mix(x ^ np.uint64(0xC2B2AE3D27D4EB4F))
        b = unit(mix(y ^ np.uint64(0x165667B19E3779F9)) >> np.uint64(32))
        r = -np.log(unit(x >> np.uint64(32)) * unit(x & low))
        log_c = np.log(-np.log(unit(y >> np.uint64(32)) * unit(y & low)))
        t = np.floor(log_w / r + b)
        log_a = log_c - r * (t - b + 1.0)
        least = np.minimum.reduceat(log_a, begins)
        hit = np.flatnonzero(log_a == least[owner])
        hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]
        chosen = mix(hashes[hit] + t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + seed)
        keys[:, i // ROWS] += chosen * _BAND_FACTORS[i % ROWS]
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def shingle_weight(count: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    return count * (1.0 + RARITY * np.log(np.maximum(n_docs / df, 1.0)) / np.log(max(n_docs, 3)))


def front(hashes: np.ndarray, weights: np.ndarray, df: np.ndarray, whole: float, similarity: float) -> tuple[bytes, bytes]:
    """A bit for each shared shingle that is among the text's rarest ones, and the weight from each of those on.

    Shingles are ordered by df and hash, those of no other text first. The front
    ends where what lies behind it weighs less than ``similarity`` of the text. If
    two texts reach that similarity, the first shingle in this order that both
    have is in the front of either, for else all they share would lie behind one.
    """
    order = np.lexsort((hashes, df))
    rest = np.empty(order.size)
    rest[order] = weights.sum() - np.cumsum(weights[order]) + weights[order]
    bits = rest >= similarity * whole * (1 - 1e-6)
    return np.packbits(bits).tobytes(), rest[bits].astype(np.float32).tobytes()


def candidates(docs: DataFrame, similarity: float = 0.8, block_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Settled: texts that may have a partner, with their shared shingles, weights and band keys.

    A text that stands in several blocks has a row for each of them.
    """
    ship(docs.sparkSession)
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_docs, blocks = size["n"], max(1, -(-size["bytes"] // block_bytes))
    buckets = max(1, -(-size["bytes"] * _KEY_BYTES // (6 * bucket_bytes)))
    spread = F.xxhash64("doc_id", "text")  # one doc_id on very many rows fills several blocks
    placed = texts.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.md5("text").alias("node"), "text")
    # Settled, so that the packed lists of all blocks can go before the sets are made. They and the
    # texts have more than twice the input; a garbage collection right after the write may come too early for them.
    shared = settle(_shared(_count_blocks(placed, buckets)), "near-shared", drop_shuffles=True)
    release(docs.sparkSession)

    def run(key: tuple, frame: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "node", "weight", "common", "hashes", "weights", "front", "rests", "keys"]
        h, row, count = _sorted_pairs(*_block_shingles(frame))
        if not h.size or not len(back):
            return pd.DataFrame([], columns=columns)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        bounds = _ranges(h[first], buckets)
        df = np.ones(first.size)
        for bucket, places, dfs in zip(back["bucket"], back["places"], back["dfs"]):
            df[bounds[bucket] + _unpack(places, 4).astype(np.int64)] = _unpack(dfs, 5)
        df = np.repeat(df, np.diff(np.append(first, h.size)))
        weight = shingle_weight(count, df, n_docs)
        whole = np.bincount(row, weight, len(frame))
        common = np.bincount(row, np.where(df > 1, weight, 0.0), len(frame))
        possible = (common >= similarity * whole * (1 - 1e-9)) & (whole > 0)
        possible &= ~frame["node"].duplicated().to_numpy()  # row numbers of slices follow the frame's order
        use = np.flatnonzero((df > 1) & possible[row])
        use = use[np.argsort(row[use], kind="stable")]
        h, w, row, df = h[use], weight[use], row[use], df[use]
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        out = []
        for k in range(0, begins.size, 64):
            b = begins[k : k + 65]
            stop = b[64] if b.size > 64 else h.size
            b = b[:64]
            bands = samples(h[b[0] : stop], w[b[0] : stop], b - b[0])
            for j, (low, high) in enumerate(zip(b, np.append(b[1:], stop))):
                doc = row[low]
                out.append((
                    key[0], frame["node"].iloc[doc], float(whole[doc]), float(common[doc]), _pack(h[low:high] >> np.uint64(24), _KEY_BYTES),
                    w[low:high].astype(np.float32).tobytes(),
                    *front(h[low:high], w[low:high], df[low:high], float(whole[doc]), similarity), bands[j].view(np.int64).tolist(),
                ))
        return pd.DataFrame(out, columns=columns)

    schema = "block int, node string, weight double, common double, hashes binary, weights binary, front binary, rests binary, keys array<long>"
    found = placed.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(run, schema)
    found = settle(found.withColumn("id", F.xxhash64("node")), "near-candidates", drop_shuffles=True)
    emptied(shared)
    return found


def weighted_jaccard(a: bytes, wa: bytes, total_a: float, b: bytes, wb: bytes, total_b: float) -> float:
    """Similarity of two weighted sets from their shared shingles (by hash, ascending) and total weights."""
    ha, hb = _unpack(a, _KEY_BYTES), _unpack(b, _KEY_BYTES)
    at = np.minimum(np.searchsorted(hb, ha), hb.size - 1)
    same = hb[at] == ha
    common = np.minimum(np.frombuffer(wa, np.float32)[same], np.frombuffer(wb, np.float32)[at[same]]).sum(dtype=np.float64)
    return float(common / (total_a + total_b - common))


#: Pairs of sets in an Arrow batch; a set of a long text has some hundred KB.
PAIRS = 128


def _verified(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b), named by the roots of the pairs whose similarity reaches the threshold.

    ``pairs`` names the block of either text. Both sides read one exchange of
    the sets; the join is by sorting at every size, so a hot centre can be split.
    """

    @F.pandas_udf("double")
    def compare(a: pd.Series, wa: pd.Series, ta: pd.Series, b: pd.Series, wb: pd.Series, tb: pd.Series) -> pd.Series:
        return pd.Series([weighted_jaccard(*x) for x in zip(a, wa, ta, b, wb, tb)], dtype=float)

    sets = found.select("id", "block", "hashes", "weights", "weight").hint("merge")
    near = compare("x.hashes", "x.weights", "x.weight", "y.hashes", "y.weights", "y.weight")
    return (
        pairs.join(sets.alias("x"), F.expr("a = x.id AND a_block = x.block"))
        .join(sets.alias("y"), F.expr("b = y.id AND b_block = y.block"))
        .filter(near >= similarity - 1e-6)
        .select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): the least id of its component.

    Alternates large-star and small-star steps over settled edges until every
    edge leads from a node with one edge to a least id; a hub's edges are folded
    by partial aggregation.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "star")
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "star")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two edges to lower ids, or one and one from a higher id."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR up = 1 AND down = 1").count() > 0


def roots(docs: DataFrame, similarity: float = 0.8, rounds: int = 4, **sizes) -> DataFrame | None:
    """(id, root) of the texts that have a link to a different text; id is the xxhash64 of the md5 of the text."""
    spark = docs.sparkSession
    found = candidates(docs, similarity, **sizes)
    release(spark)
    home = found.groupBy("id").agg(F.min(F.struct("block", "weight", "common", "keys")).alias("h"))
    members = settle(home.select("id", F.explode(F.array_distinct("h.keys")).alias("key"), "h.block", "h.weight", "h.common"), "near-members")
    known = None
    for turn in range(rounds):
        own = members.withColumn("root", F.col("id"))
        if known is not None:
            own = members.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
        order = F.struct((F.col("id") if turn == 0 else F.xxhash64("id", "key", F.lit(turn))).alias("o"), "id", "root", "block", "weight", "common")
        centre = own.groupBy("key").agg(F.min(order).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
        centre = centre.filter("low <> high").select("key", "c")
        pairs = _apart(own.join(centre, "key"), "common", similarity)
        pairs = settle(pairs, "near-pairs")
        new = settle(_verified(pairs, found, similarity), "near-links", records=PAIRS, drop_shuffles=True)
        if linked := new.count():
            known = settle(_merged(known, settle(components(new), "near-merges")), "near-roots")
        done = linked * FEW_LINKS < pairs.count()
        del own, centre, pairs
        release(spark)  # the sets that this round exchanged
        if done:
            break
    pairs = settle(_open_pairs(found, members, known, similarity), "near-pairs")
    new = settle(_verified(pairs, found, similarity), "near-links", records=PAIRS, drop_shuffles=True)
    if not new.isEmpty():
        known = settle(_merged(known, settle(components(new), "near-merges")), "near-roots")
    emptied(found)
    emptied(members)
    release(spark)
    return known


def _apart(pairs: DataFrame, bound: str, similarity: float) -> DataFrame:
    """The pairs of a member and ``c`` that are in different classes and may be similar, once each.

    The column ``bound`` has the most that a text can share with the other one.
    """
    least = (similarity - 1e-5) / (1 + similarity - 1e-5)  # of both weights
    return (
        pairs.filter(F.col("root") != F.col("c.root"))
        .filter(F.least(bound, f"c.{bound}") >= least * (F.col("weight") + F.col("c.weight")))
        .select(
            F.col("id").alias("a"), F.col("block").alias("a_block"), F.col("root").alias("a_root"),
            F.col("c.id").alias("b"), F.col("c.block").alias("b_block"), F.col("c.root").alias("b_root"),
        )
        .distinct()
    )


def _open_pairs(found: DataFrame, members: DataFrame, known: DataFrame | None, similarity: float) -> DataFrame:
    """Pairs of different classes that share a shingle of both fronts, among texts of undecided buckets.

    At the first shingle that two similar texts share, either has at least the
    weight left that they must share. In a group of near copies or of one template
    each text has spent weight on changes of its own before it comes to the shingles
    of the group, so only pairs with few changes in both are left to compare.
    """
    own = members.withColumn("root", F.col("id"))
    if known is not None:
        own = members.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    texts = settle(own.join(open_, "key").select("id", "block", "root", "weight").distinct(), "near-open")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, rests = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
            for hashes, bits, rest in zip(frame["hashes"], frame["front"], frame["rests"]):
                all_ = _unpack(hashes, _KEY_BYTES)
                held.append(all_[np.unpackbits(np.frombuffer(bits, np.uint8), count=all_.size).view(bool)].astype(np.int64))
                rests.append(np.frombuffer(rest, np.float32))
            out = frame[["id", "block", "root", "weight"]].loc[frame.index.repeat([x.size for x in held[1:]])].reset_index(drop=True)
            yield out.assign(shingle=np.concatenate(held), rest=np.concatenate(rests))

    sets = found.select("id", "block", "hashes", "front", "rests").join(texts, ["id", "block"])
    fronts = settle(sets.mapInPandas(run, "id long, block int, root long, weight double, shingle long, rest float"), "near-fronts", records=1000)
    met = fronts.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    met = settle(fronts.join(met.select("shingle"), "shingle"), "near-met")
    right = met.select("shingle", F.struct("id", "root", "block", "weight", "rest").alias("c"))
    return _apart(met.join(right, "shingle").filter("id < c.id"), "rest", similarity)


def _merged(known: DataFrame | None, merges: DataFrame) -> DataFrame:
    """``known`` (id, root) after its roots have been merged as ``merges`` (id, root) says."""
    if known is None:
        return merges
    step = merges.select(F.col("id").alias("root"), F.col("root").alias("later"))
    moved = known.join(step, "root", "left").select("id", F.coalesce("later", "root").alias("root"))
    return moved.unionByName(merges.join(known, "id", "left_anti"))


def _memberships(docs: DataFrame, similarity: float, **options) -> DataFrame:
    """Settled doc_id, node and class key of every row; the class key is null for a null text."""
    known = roots(docs, similarity, **options)
    rows = docs.select("doc_id", F.md5("text").alias("node")).withColumn("id", F.xxhash64("node"))
    if known is None:
        return settle(rows.withColumn("class", F.col("node")).drop("id"), "near-rows")
    rows = rows.join(known, "id", "left").withColumn("class", F.when(F.col("node").isNotNull(), F.coalesce(F.col("root").cast("string"), "node")))
    return settle(rows.select("doc_id", "node", "class"), "near-rows")


def classes(docs: DataFrame, similarity: float = 0.8, **options) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and class_size of every document."""
    rows = _memberships(docs, similarity, **options)
    named = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    named = settle(named, "near-classes")  # a plain scan, so that a hot class can be split in the join
    return rows.join(named, "class", "left").select(
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def keep_one(docs: DataFrame, similarity: float = 0.8, **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the least doc_id; null texts stay."""
    rows = _memberships(docs, similarity, **options).filter("class IS NOT NULL")
    named = settle(rows.groupBy("class").agg(F.min("doc_id").alias("class_id")), "near-classes")
    first = rows.join(named, "class").filter("doc_id <=> class_id")
    chosen = first.groupBy("class").agg(F.min("node").alias("node"))
    kept = first.join(chosen, ["class", "node"]).groupBy("class", "node", "class_id").agg(F.count("*").alias("_kept_rows"))
    kept = settle(kept.select(F.col("node").alias("_kept_node"), F.col("class_id").alias("_kept_id"), "_kept_rows"), "near-kept")
    joined = docs.join(kept, (F.md5(docs["text"]) == kept["_kept_node"]) & docs["doc_id"].eqNullSafe(kept["_kept_id"]))
    columns = [docs[c] for c in docs.columns]
    single = joined.filter("_kept_rows = 1").select(*columns)
    repeated = joined.filter("_kept_rows > 1").dropDuplicates(["_kept_node", "_kept_id"]).select(*columns)
    return single.unionByName(repeated).unionByName(docs.filter(docs["text"].isNull()))
