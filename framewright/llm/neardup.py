"""Near-duplicate texts by SimHash and Golay-code fuzzy keys.

One pass over the texts makes a profile of each: a SimHash of FAMILIES * 46 + PLAIN_BITS bits over its words (A-Z
lowered, each once), the number of its five-word shingles, their parities (below) and the prefix of their set.

First search. Texts that share 0.8 of their five-word shingles differ in about one bit of fifteen, too many for one
64-bit fingerprint; so there are FAMILIES pairs of 23-bit segments, and a pair of segments gives a key where both differ
in at most one bit: the indices of the Golay codewords near to them. One side of a pair of texts needs all near
codewords, the other the nearest alone; a hash of text and family gives one text in four the first role. Texts that
meet under a key and differ in few of the further PLAIN_BITS bits are candidates. In a bucket of many alike texts a text
is compared with the centre of its cluster (the text closest to the cluster's majority of bits, which is what copies
were made from) and with a neighbour that is closer than the middle. Buckets of all families name a large cluster by its
majority bits, so it has one centre however many buckets it fills. This links the bulk of large groups cheaply, and may
miss links.

Second search, which misses none. Of two sets of shingles that are alike enough, the prefixes share a shingle, whatever
the order (rarest first here, as far as a sample tells): so texts meet under each shingle of their prefix, and all pairs
that the first search left in different components are candidates. Shingles in the prefixes of more than HOT_ROWS texts
are counted before anything is dealt by them; their rows are dealt by cells, pairs of blocks of a bounded size, never
whole (``cells``). Where another bucket has many more pairs than rows, the parities are compared inside the bucket, each text gets the nearest of its possible partners first, and what that leaves
in different components goes on to a round with more partners, until no partner is left out.

Parities: bit i tells whether an odd number of a text's shingles falls to place i. Two texts' parities differ in no more
bits than their sets differ in shingles, so candidates that differ in too many bits can't be alike enough and go. What
decides on the others is the exact Jaccard similarity of their sets.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, packed, ship, stored, text_of, tidy, unpacked, with_filter
from .simhash import golay_indices, golay_tables, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
FAMILIES = 16
PLAIN_BITS = 34
KEY_SHIFT = PLAIN_BITS + 1
#: Candidates differ in at most so many of the plain bits.
PLAIN_DISTANCE = 9
#: Up to this size all pairs of a bucket are candidates.
SMALL_BUCKET = 12
#: From this size a cluster is named, and has one centre in all buckets.
NAMED_CLUSTER = 96
#: Texts in the sample that tells common shingles, and how many of these are known. They only set the order of shingles.
SAMPLE, COMMON = 12_500, 20_000
#: Low bits of a prefix key: the logarithm of the number of shingles to the base SIZE_STEP. SIZE_REACH is that of 1 / SIMILARITY.
SIZE_BITS, SIZE_STEP = 12, 1.02
SIZE_REACH = math.ceil(-math.log(SIMILARITY) / math.log(SIZE_STEP))
#: A bucket of more pairs than rows times this has its rows' parities compared before pairs are given out.
PAIRS_A_ROW = 4
#: A bucket of more pairs than this is dealt out to several tasks.
MOST_PAIRS = 50_000_000
#: A prefix shingle of more texts than this is dealt out before its rows meet. There are MOST_HOT of them at most: beyond
#: HOT_ROWS * MOST_HOT rows a shingle has to be in a MOST_HOT-th of all prefixes. PLACES: counters of the first count.
HOT_ROWS, MOST_HOT, PLACES = 20_000, 1_000_000, 1 << 20
#: Partners that a row of such a bucket is given in the first round, in all its cells; each further round gives MORE_PARTNERS times as many.
FIRST_PARTNERS, MORE_PARTNERS = 4, 16
_BYTES = (FAMILIES * 46 + PLAIN_BITS + 7) // 8


class _Bits(dict):
    """The random bits of words; starts anew when it is full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 100_000:
            self.clear()
        seeds = range((_BYTES + 15) // 16)
        self[word] = out = b"".join(xxhash.xxh3_128_digest(word, seed=s) for s in seeds)[:_BYTES]
        return out


_bits = _Bits()


def word_simhash(text: str) -> bytes | None:
    """Majority bits over the text's distinct words; None for a text without words."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return None
    votes = np.zeros(_BYTES * 8, dtype=np.int64)
    listed = list(words)
    for at in range(0, len(listed), 4096):
        part = b"".join(map(_bits.__getitem__, listed[at : at + 4096]))
        votes += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, _BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(words)).tobytes()


def nearest_index(x: np.ndarray) -> np.ndarray:
    """Index of the codeword within 3 bits of each 23-bit word. A syndrome's first pattern is the lightest."""
    low, high, errors, _ = golay_tables()
    return (x ^ errors[low[x & 4095] ^ high[x >> 12], 0]) >> 11


def family_keys(prints: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, packed): keys of each print; packed holds family and indices above the plain bits, and whether the key is home.

    A text's home key is that of the nearest codewords. Two texts in reach of each other meet under the home key of at
    least one of them, so texts that are both away from home needn't be compared.
    """
    bits = np.unpackbits(prints, axis=1).astype(np.int64)
    number = lambda a, n: bits[:, a : a + n] @ (1 << np.arange(n, dtype=np.int64))
    plain = number(FAMILIES * 46, PLAIN_BITS)
    rows, keys = [], []
    for t in range(FAMILIES):
        a, b = number(46 * t, 23), number(46 * t + 23, 23)
        coin = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) >> np.uint64(62)
        many = np.flatnonzero(coin == 0)
        one = np.flatnonzero(coin != 0)
        (ra, ia), (rb, ib) = golay_indices(a[many]), golay_indices(b[many])
        nb = np.bincount(rb, minlength=len(many))
        first = np.cumsum(nb) - nb
        left = np.repeat(np.arange(len(ra)), nb[ra])
        right = first[ra[left]] + np.arange(len(left)) - np.repeat(np.cumsum(nb[ra]) - nb[ra], nb[ra])
        home = nearest_index(a) << 12 | nearest_index(b)
        away = ia[left] << 12 | ib[right]
        rows += [one, many[ra[left]]]
        keys += [(t << 24 | home[one]) << 1 | 1, (t << 24 | away) << 1 | (away == home[many[ra[left]]])]
    row, key = np.concatenate(rows), np.concatenate(keys)
    return row, (key >> 1) << KEY_SHIFT | plain[row] << 1 | (key & 1)


def bucket_pairs(packed: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate pairs of nodes among rows with equal keys, members of clusters as majority bits, node, distance to the bits)."""
    order = np.lexsort((node, packed))
    packed, node = packed[order], node[order]
    key, plain, home = packed >> KEY_SHIFT, packed >> 1 & ((1 << PLAIN_BITS) - 1), (packed & 1).astype(bool)
    if not len(key):
        return np.zeros((0, 2), dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([cut, [len(key)]]))
    own = np.repeat(size, size)
    found, members = [], [np.zeros((0, 3), dtype=np.int64)]
    live = np.flatnonzero((own > 1) & (own <= SMALL_BUCKET))
    for d in range(1, SMALL_BUCKET):
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
        if not len(live):
            break
        hit = live[(np.bitwise_count(plain[live] ^ plain[live + d]) <= PLAIN_DISTANCE) & (home[live] | home[live + d])]
        found.append(np.stack([node[hit], node[hit + d]], axis=1))
    for at, n in zip(cut[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
        for middle, own, distance in clusters(plain[at : at + n]):
            own = own + at
            at_home = home[own]
            if not at_home.any():
                continue
            # neighbours that are closer to each other than to the middle
            near = np.bitwise_count(plain[own[:-1]] ^ plain[own[1:]]) < np.maximum(distance[:-1], distance[1:])
            near &= at_home[:-1] | at_home[1:]
            if len(own) >= NAMED_CLUSTER:
                near &= at_home[:-1] & at_home[1:]  # the others are at home in clusters of the same name
                members.append(np.stack([np.full(int(at_home.sum()), middle), node[own[at_home]], distance[at_home]], axis=1))
            else:
                centre = own[at_home][distance[at_home].argmin()]
                found.append(np.stack([node[own], np.full(len(own), node[centre])], axis=1))
            found.append(np.stack([node[own[:-1][near]], node[own[1:][near]]], axis=1))
    pairs = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), dtype=np.int64)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0), np.unique(np.concatenate(members), axis=0)


def clusters(plain: np.ndarray):
    """Clusters of a large bucket: (majority bits, rows, their distances to these bits)."""
    open_ = np.arange(len(plain))
    while len(open_) > 1:
        own = open_[np.bitwise_count(plain[open_] ^ plain[open_[0]]) <= PLAIN_DISTANCE]
        ones = np.array([np.count_nonzero(plain[own] >> i & 1) for i in range(PLAIN_BITS)])
        middle = int(np.sum((ones * 2 > len(own)).astype(np.int64) << np.arange(PLAIN_BITS)))
        # the cluster is what lies around the middle, and what led to it
        own = np.union1d(own, open_[np.bitwise_count(plain[open_] ^ middle) <= PLAIN_DISTANCE])
        distance = np.bitwise_count(plain[own] ^ middle).astype(np.int64)
        yield middle, own, distance
        open_ = np.setdiff1d(open_, own)


def prefix_keys(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, rarest first, each with the size of the set in its low bits.

    So many that sets with a similarity of SIMILARITY share one. common (sorted) and counts tell how often shingles occur.
    """
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = np.where(common[at] == shingles, counts[at], 0)
    first = shingles[np.argsort(often, kind="stable")[: n - math.ceil(SIMILARITY * n - 1e-6) + 1]]
    return first >> SIZE_BITS << SIZE_BITS | int(math.log(n) / math.log(SIZE_STEP))


def parities(shingles: np.ndarray) -> bytes:
    """For each of 64 * 2 ** k places, at least as many as there are shingles: whether an odd number falls to it."""
    bits = 64
    while bits < len(shingles):
        bits *= 2
    place = (shingles.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(words: np.ndarray) -> np.ndarray:
    """Parities over half as many places. words: 64-bit words of parities in the last axis."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def may_be_alike(differ: np.ndarray, sizes: np.ndarray, size) -> np.ndarray:
    """Whether sets of these sizes whose parities differ in so many bits can be alike enough."""
    few = differ * (1 + SIMILARITY) <= (sizes + size) * (1 - SIMILARITY) + 1e-6
    return few & (np.minimum(sizes, size) >= SIMILARITY * np.maximum(sizes, size) - 1e-6)


def alike_by_parity(x: list[bytes], n: np.ndarray, y: list[bytes], m: np.ndarray) -> np.ndarray:
    """For pairs of texts with parities x, y and sizes n, m: whether they can be alike enough."""
    out = np.zeros(len(x), dtype=bool)
    widths = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], dtype=np.int64).reshape(-1, 2)
    for wa, wb in np.unique(widths, axis=0).tolist():
        at = np.flatnonzero((widths == (wa, wb)).all(axis=1))
        if max(wa, wb) > 2 * min(wa, wb):
            continue  # one set has over twice the shingles of the other
        words = [np.frombuffer(b"".join(v[i] for i in at.tolist()), dtype=np.uint64).reshape(len(at), -1) for v in (x, y)]
        words = [folded(v) if v.shape[1] * 8 > min(wa, wb) else v for v in words]
        out[at] = may_be_alike(np.bitwise_count(words[0] ^ words[1]).sum(axis=1, dtype=np.int64), n[at], m[at])
    return out


def by_buckets(bucket: np.ndarray, node: np.ndarray, root: np.ndarray):
    """(order, own, last): rows by bucket, components of a bucket from small to large; where each row's component and bucket end."""
    order = np.lexsort((node, root, bucket))

    def ends(*columns):
        """For each row, the end and the length of its run of equal values."""
        new = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]])
        return np.repeat(cut[1:], np.diff(cut)), np.repeat(np.diff(cut), np.diff(cut))

    order = order[np.lexsort((root[order], ends(bucket, root)[1], bucket[order]))]
    return order, ends(bucket, root)[0], ends(bucket)[0]


def prefix_pairs(packed: np.ndarray, node: np.ndarray, root: np.ndarray):
    """Yields (a, b, None): pairs of nodes of different roots and like sizes that share a prefix key.

    Of buckets with more than PAIRS_A_ROW pairs a row it yields (nodes, buckets, blocks): their rows, and into how many blocks
    to deal each bucket.
    """
    bucket, size = packed >> SIZE_BITS, packed & ((1 << SIZE_BITS) - 1)
    order, own, last = by_buckets(bucket, node, root)
    partners = last - own  # a row's partners are what stands behind its own component
    start = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
    rows = np.diff(np.concatenate([start, [len(order)]]))
    pairs = np.add.reduceat(partners, start)
    many = pairs > PAIRS_A_ROW * rows
    if many.any():
        blocks = np.where(pairs > MOST_PAIRS, np.ceil(np.sqrt(pairs / MOST_PAIRS)).astype(np.int64) + 1, 1)
        here = np.repeat(many, rows)
        yield node[order[here]], bucket[order[here]] << SIZE_BITS, np.repeat(blocks[many], rows[many])
        partners = np.where(here, 0, partners)
    total = np.cumsum(partners)
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, total[at] - partners[at] + 1_000_000, side="right")))
        n = partners[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = own[left] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        left, right = order[left], order[right]
        near = np.abs(size[left] - size[right]) <= SIZE_REACH
        found = np.unique(np.sort(np.stack([node[left[near]], node[right[near]]], axis=1), axis=1), axis=0)
        if len(found):
            yield found[:, 0], found[:, 1], None
        at = to


def nearest_partners(bucket: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, parity: list[bytes], most: np.ndarray):
    """Yields (a, b, None): each row with the nearest ``most`` rows behind its component that can be alike enough.

    Of buckets where a row has more such partners it yields (None, None, rows) too.
    """
    order, own, last = by_buckets(bucket, node, root)
    width = np.array([len(p) for p in parity], dtype=np.int64)
    at = 0
    while at < len(order):
        end = int(last[at])
        rows = order[at:end]
        place = {w: np.flatnonzero(width[rows] == w) for w in np.unique(width[rows]).tolist()}
        whole = {w: np.frombuffer(b"".join(parity[i] for i in rows[p].tolist()), dtype=np.uint64).reshape(len(p), -1) for w, p in place.items()}
        half = {w // 2: folded(m) for w, m in whole.items() if w > 8}
        left, right, more = [], [], False
        for i in range(end - at):
            behind = int(own[at + i]) - at
            if behind == end - at:
                break
            r = int(rows[i])
            w, n = int(width[r]), int(size[r])
            mine = np.frombuffer(parity[r], dtype=np.uint64)
            near, far = [], []
            for v, known, key in ((mine, whole, w), (mine, half, w), (folded(mine) if w > 8 else None, whole, w // 2)):
                p = place.get(key if known is whole else 2 * key)
                if v is None or p is None or key not in known:
                    continue
                first = int(np.searchsorted(p, behind))
                if first == len(p):
                    continue
                differ = np.bitwise_count(known[key][first:] ^ v).sum(axis=1, dtype=np.int64)
                ok = np.flatnonzero(may_be_alike(differ, size[rows[p[first:]]], n))
                near.append(p[first:][ok])
                far.append(differ[ok])
            if not near or not sum(map(len, near)):
                continue
            near, far = np.concatenate(near), np.concatenate(far)
            if len(near) > most[r]:
                more = True
                near = near[np.argsort(far, kind="stable")[: most[r]]]
            left.append(np.full(len(near), r))
            right.append(rows[near])
        if left:
            found = np.sort(np.stack([node[np.concatenate(left)], node[np.concatenate(right)]], axis=1), axis=1)
            yield found[:, 0], found[:, 1], None
        if more:
            yield None, None, rows
        at = end


def node_of():
    """A text's node: a digest of doc_id and text, so rows that share a doc_id stay apart."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of())


def near_links(docs: DataFrame) -> DataFrame:
    """(a, b): links between nodes of texts whose five-word shingles have a Jaccard similarity of SIMILARITY or more.

    All such texts are connected by links; not each pair of them has its own. Shorter texts count as one shingle. Texts
    without words have no links.
    """
    ship(docs.sparkSession)
    nodes = docs.select(node_of().alias("node"), text_of().alias("text"))
    rows = nodes.count()
    known = stored(profiles(nodes, common_shingles(nodes, rows)), "profiles")
    links = [alike(nodes, possible(met_by_bits(known, rows), known))]
    roots = components(links[0])
    met, hot = met_by_prefix(known, rows, roots)
    links.append(alike(nodes, possible(met.where("NOT whole").select("a", "b").distinct(), known)))
    rest = blocks(met.where("whole").select(F.col("b").alias("bucket"), F.col("a").alias("node"), "blocks").distinct()).union(hot)
    partners = FIRST_PARTNERS
    while not rest.isEmpty():
        forget(roots)
        roots = components(union(links))
        found = stored(met_by_parity(rest, known, roots, partners), "met")
        forget(met, hot)
        links.append(alike(nodes, stored(found.where("NOT whole").select("a", "b").distinct(), "candidates")))
        rest = found.where("whole").select(F.col("b").alias("bucket"), F.col("a").alias("node"), F.col("blocks").alias("cells"))
        met, partners = found, partners * MORE_PARTNERS
    out = stored(union(links), "near-links")
    forget(roots, met, hot, known, *links)
    return out


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def met_by_bits(known: DataFrame, rows: int) -> DataFrame:
    """(a, b): candidates of the first search over profiles."""
    spark = known.sparkSession

    def keys(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            print_ = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, _BYTES)
            for at in range(0, len(node), 1500):
                row, packed = family_keys(print_[at : at + 1500], node[at : at + 1500])
                yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(node[at : at + 1500][row])], ["packed", "node"])

    def pairs(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            found, members = bucket_pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], ["a", "b", "cluster"])
            yield pa.RecordBatch.from_arrays([pa.array(members[:, 1]), pa.array(members[:, 2]), pa.array(members[:, 0])], ["a", "b", "cluster"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * 130 // 1_500_000)
    met = known.select("node", "bits").mapInArrow(tidy(keys), "packed long, node long").repartition(n, F.shiftright("packed", KEY_SHIFT)).mapInArrow(tidy(pairs), "a long, b long, cluster long")
    met = stored(met.distinct(), "met")
    members = met.where("cluster IS NOT NULL").select("cluster", F.col("a").alias("member"), F.col("b").alias("distance"))
    centres = members.groupBy("cluster").agg(F.min(F.struct("distance", "member"))["member"].alias("centre"))
    spokes = members.join(centres, "cluster").select(F.least("member", "centre").alias("a"), F.greatest("member", "centre").alias("b")).where("a <> b")
    out = stored(met.where("cluster IS NULL").select("a", "b").union(spokes).distinct(), "candidates")
    forget(met)
    return out


def shingle_sets(batches):
    """node and the sorted set of shingles of each text."""
    for batch in batches:
        sets = [np.unique(shingle_hashes(t, SHINGLE).view(np.int64)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def common_shingles(nodes: DataFrame, rows: int) -> np.ndarray:
    """The commonest shingles of a sample, sorted, and how often they are in it, as rows. They set the order of prefixes only."""
    sample = nodes.where(F.pmod("node", F.lit(max(1, rows // SAMPLE))) == 0).mapInArrow(tidy(shingle_sets), "node long, shingles array<long>")
    often = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).collect()
    return np.array(sorted((r[0], r[1]) for r in often), dtype=np.int64).reshape(-1, 2)


def profiles(nodes: DataFrame, often: np.ndarray) -> DataFrame:
    """node, bits (SimHash), size (number of shingles), parity, keys (prefix) of each text that has words."""

    def run(batches):
        for batch in batches:
            out = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = word_simhash(text)
                if bits is not None:
                    set_ = np.unique(shingle_hashes(text, SHINGLE).view(np.int64))
                    out.append((node, bits, len(set_), parities(set_), prefix_keys(set_, often[:, 0], often[:, 1])))
            if out:
                node, bits, size, parity, keys = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.array(size, pa.int64()), pa.array(parity, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "bits", "size", "parity", "keys"])

    return nodes.mapInArrow(tidy(run), "node long, bits binary, size long, parity binary, keys array<long>")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their node: itself where roots hasn't the node. Only rows that may have another are shuffled."""
    marked = with_filter(rows, F.col("node"), roots, "node", "rooted")
    some = marked.where("rooted").drop("rooted").join(roots, "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))
    return marked.where("NOT rooted").select(*rows.columns, F.col("node").alias("root")).union(some)


MET = "a long, b long, blocks long, whole boolean"


def _met(a, b, blocks, whole: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if blocks is None else pa.array(blocks, pa.int64()), pa.array(np.full(len(a), whole))], ["a", "b", "blocks", "whole"])


def met_by_prefix(known: DataFrame, rows: int, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of nodes with different roots, and rows that are yet to be compared in their cells.

    The first table has a, b, blocks, whole; where whole, node a is in bucket b, whose rows are yet to be dealt to blocks
    and compared. The second, from hot shingles, has bucket, node, cells as ``met_by_parity`` takes them.
    """
    spark = known.sparkSession

    def pairs(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            for a, b, blocks in prefix_pairs(*(np.concatenate(c) for c in zip(*parts, strict=True))):
                yield _met(a, b, blocks, blocks is not None)

    hot = hot_shingles(known)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * 80 // 1_500_000)
    each = with_roots(known.select("node", "keys"), roots).select(F.explode("keys").alias("packed"), "node", "root")
    bucket = F.shiftright("packed", SIZE_BITS)
    hot_rows = stored(each.withColumn("bucket", bucket).join(F.broadcast(hot), "bucket", "left_semi").select("bucket", "node", "root"), "hot")
    dealt = stored(cells(hot_rows), "cells")
    rest = each.join(F.broadcast(hot.withColumnRenamed("bucket", "hot")), bucket == F.col("hot"), "left_anti")
    met = stored(rest.repartition(n, bucket).mapInArrow(tidy(pairs), MET), "met")
    forget(hot, hot_rows)
    return met, dealt


def hot_shingles(known: DataFrame) -> DataFrame:
    """bucket: what is in the prefixes of more than HOT_ROWS texts, MOST_HOT at most.

    Places to which the shingles are hashed are counted first, in a table of PLACES rows a task; shingles alone only
    where their place has rows enough. So counting shuffles little, and no hot shingle is missed.
    """
    each = known.select(F.explode("keys").alias("packed")).select(F.shiftright("packed", SIZE_BITS).alias("bucket"))
    total = known.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    least = max(HOT_ROWS, total // MOST_HOT)
    place = F.pmod(F.xxhash64("bucket", F.lit("place")), F.lit(PLACES))
    busy = stored(each.groupBy(place.alias("place")).count().where(F.col("count") > least).select("place"), "places")
    some = each.withColumn("place", place).join(F.broadcast(busy), "place", "left_semi")
    out = stored(some.groupBy("bucket").count().where(F.col("count") > least).select("bucket"), "hot")
    forget(busy)
    return out


def block_of(blocks):
    return F.pmod(F.xxhash64("node", F.lit("block")), blocks)


def numbers_below(n):
    return F.sequence(F.lit(0).cast("long"), n - 1)


def cells(rows: DataFrame) -> DataFrame:
    """(bucket, node, cells) from stored (bucket, node, root) of hot shingles: the cells each row is in, and how many.

    A bucket's rows of its largest component need not meet each other. They and the others are dealt to blocks of about
    sqrt(MOST_PAIRS) rows; each block of the one kind meets each of the other, and blocks of others meet too. So a row is
    repeated as often as there are blocks it has to meet, and components that fill their bucket alone make no cells.
    """
    side = math.isqrt(MOST_PAIRS)
    sizes = rows.groupBy("bucket", "root").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("top"))
    ceil = lambda n: F.ceil(n / side).cast("long")
    known = sizes.where("n > top.count").select("bucket", F.col("top.root").alias("top"), ceil(F.col("top.count")).alias("mine"), ceil(F.col("n") - F.col("top.count")).alias("others"))
    # one row a hot shingle, MOST_HOT at most
    met = rows.join(F.broadcast(known), "bucket")
    top = met.where("root = top").select("bucket", "node", block_of(F.col("mine")).alias("x"), F.explode(numbers_below(F.col("others"))).alias("y"), F.lit("top").alias("kind"), F.col("others").alias("cells"))
    other = met.where("root <> top").withColumn("own", block_of(F.col("others"))).withColumn("cells", F.col("mine") + F.col("others") - 1)
    to_top = other.select("bucket", "node", F.explode(numbers_below(F.col("mine"))).alias("x"), F.col("own").alias("y"), F.lit("top").alias("kind"), "cells")
    pairs = other.withColumn("k", F.explode(numbers_below(F.col("others")))).where("k <> own")
    to_others = pairs.select("bucket", "node", F.least("k", "own").alias("x"), F.greatest("k", "own").alias("y"), F.lit("other").alias("kind"), "cells")
    return union([top, to_top, to_others]).select(F.xxhash64("bucket", "kind", "x", "y").alias("bucket"), "node", "cells")


def blocks(rest: DataFrame) -> DataFrame:
    """(bucket, node, cells) from whole buckets (bucket, node, blocks): each pair of blocks of a bucket becomes a bucket of its own."""
    dealt = rest.withColumn("block", block_of(F.col("blocks"))).withColumn("other", F.explode(numbers_below(F.col("blocks"))))
    name = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    return dealt.select(name.alias("bucket"), "node", F.col("blocks").alias("cells"))


def met_by_parity(rest: DataFrame, known: DataFrame, roots: DataFrame, partners: int) -> DataFrame:
    """a, b, blocks, whole as above, from rows of buckets that a task can hold. What is whole has the cells of its row as blocks."""
    spark = known.sparkSession

    def pairs(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            bucket, node, root, size, cells = (table.column(c).to_numpy() for c in ("bucket", "node", "root", "size", "cells"))
            most = np.maximum(1, partners // cells)
            for a, b, left in nearest_partners(bucket, node, root, size, table.column("parity").to_pylist(), most):
                yield _met(a, b, None, False) if left is None else _met(node[left], bucket[left], cells[left], True)

    dealt = with_roots(rest, roots).join(known.select("node", "size", "parity").dropDuplicates(["node"]), "node")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rest.count() // 100_000)
    return dealt.select("bucket", "node", "root", "size", "cells", "parity").repartition(n, "bucket").mapInArrow(tidy(pairs), MET)


def possible(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates (a, b) that can be alike enough, as their sizes and parities tell."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = alike_by_parity(batch.column(3).to_pylist(), n, batch.column(5).to_pylist(), m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    side = lambda c: known.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}")).dropDuplicates([c])
    both = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "parity_a", "size_b", "parity_b")
    out = stored(both.mapInArrow(tidy(run), "a long, b long"), "candidates")
    forget(candidates)
    return out


def alike(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (a, b; stored, deleted afterwards) whose Jaccard similarity is SIMILARITY or more, as a stored table."""
    asked = stored(candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct(), "asked")
    some = with_filter(nodes, F.col("node"), asked, "node", "asked").where("asked").drop("asked")
    sets = stored(some.join(asked, "node", "left_semi").mapInArrow(tidy(shingle_sets), "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    both = candidates.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = stored(both.where(common >= SIMILARITY * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    forget(asked, sets, candidates)
    return out


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, columns unchanged: the one with the smallest doc_id.

    Groups are the connected components of near_links. Equal rows are one text; all of them stay or go. Null texts count
    as empty and stay, as all texts without words do; texts are read whole, however long; an empty table gives an empty
    one; columns travel whatever their names.
    """
    links = near_links(docs)
    roots = components(links)
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), node_of().alias("node")).join(roots, "node")
    stay = stored(ids, "near-ids")
    first = stay.groupBy("root").agg(F.min(F.struct("_id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    go = stored(stay.select("node").distinct().join(first, "node", "left_anti"), "near-copies")
    forget(links, roots, stay)
    # rows that surely stay aren't shuffled
    marked = with_filter(packed(docs, node=node_of()), F.col("node"), go, "node", "copied")
    rest = marked.where("copied").join(go, "node", "left_anti")
    return unpacked(marked.where("NOT copied").select("row").union(rest.select("row")), docs.columns)
