"""Near copies for the pipeline: operator 2's links, and those of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Operator 2 runs first and whole: SimHashes over shingles of three words, covering masks, links at 2 or fewer bits. Most pairs at 0.8 are further apart; a covering
radius that reaches them (their SimHashes differ in up to 11 of 64 bits and more) needs 4095 masks, or
blocks of so few bits that every bucket is large. So more candidates come from MinHash: BANDS keys of ROWS minima each;
a pair at similarity 0.8 misses all keys with a probability of 0.0004, a more similar pair with less. Every candidate is
compared by its shingles (as 64-bit hashes), so these links hold nothing below 0.8. Groups are linked over both kinds of links.

Equal sets of shingles are one node. In the first round each bucket compares its members with one member drawn by hash,
which joins groups of copies without meeting in pairs. In the second, the members of buckets that are not all connected yet meet in clusters. Members of a
bucket of up to SMALL nodes are in one cluster. Those of larger buckets are parted exactly, by prefixes: a pair at 0.8 or more shares one of the
rarest fifth of each one's shingles, so a text whose rarest fifth occurs nowhere else in these buckets has no partner, and texts whose prefixes share a shingle are in one
cluster. A cluster is compared in blocks of BLOCK nodes, each pair of blocks in one task, which counts common shingles exactly and sends a spanning forest of the
links that it finds: never the pairs that it looks at. So no member of a bucket is left out, whatever its size, and no task holds more than two blocks. Groups are linked over any
steps, and the smallest row id of each stays. What a cluster costs grows with the square of its members over BLOCK.

What the first round joins of a node are its size and a sketch, the low byte of its 100 minima. Pairs of which fewer than LEAST of 100 agree
are dropped (at 0.8 that is five deviations away, one pair in a million); only what is left meets by texts, and is compared exactly.

Results in special cases. Null, empty and blank texts have no words: they are equal to each other and to nothing else. Fewer words than a shingle
has are one shingle. Empty table: no rows. Very long texts: whole. Repeated rows: one stays. Rows with equal or null doc_ids are told apart by
shared.with_row_ids. Ties: equal ids are ordered by text. Extra columns, also of names used here, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, done_with, keeps_columns, let_go, sifted, small, stored, with_row_ids
from .simhash import near_duplicates, shingle_hashes

SEED, BANDS, ROWS, SMALL = 42, 20, 5, 128
#: Nodes of a block, and minima of two sketches that agree at least.
BLOCK, LEAST = 256, 60
#: Shingles whose minima are taken at once.
AT_ONCE = 4096
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def _minima(count: int, seed: int = SEED):
    """A function from a set of shingles to so many minima of it under different hashes."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, (count, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, (count, 1), np.uint64)

    def least(s: np.ndarray) -> np.ndarray:
        out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), AT_ONCE):
            out = np.minimum(out, ((s[None, at : at + AT_ONCE] ^ flip) * odd).min(1))
        return out

    return least


def _signatures(words: int):
    minima = _minima(BANDS * ROWS)

    def run(batches):
        let_go()
        for batch in small(batches):
            high, low, size, found, sketch = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text or b"", words)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                high.append(whole >> 64)
                low.append(whole & (1 << 64) - 1)
                size.append(len(s))
                least = minima(s)
                keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)] if len(s) else []
                found.append(np.array(keys, np.uint64).view(np.int64))
                sketch.append(least.astype(np.uint8).tobytes())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            columns = [batch.column("_rid"), signed(high), signed(low), pa.array(size, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_rid", "high", "low", "n", "keys", "sketch"])

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _alike(batches):
    """Pairs (a, b, sa, sb) whose sketches agree often enough."""
    for batch in small(batches, 8192):
        if batch.num_rows:
            agree = (_sketches(batch.column("sa")) == _sketches(batch.column("sb"))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(agree >= LEAST))


def _compared(words: int):
    def run(batches):
        for batch in small(batches):
            last, sets, good = None, None, []
            texts = zip(batch.column("ta").cast(pa.binary()).to_pylist(), batch.column("tb").cast(pa.binary()).to_pylist(), strict=True)
            for b, (ta, tb) in zip(batch.column("b").to_pylist(), texts, strict=True):
                if b != last:  # rows come sorted by b mostly
                    last, sets = b, shingle_set(tb or b"", words)
                good.append(similar(shingle_set(ta or b"", words), sets))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(words: int):
    def run(batches):
        for batch in small(batches, 64):
            sets = [shingle_set(t or b"", words).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            at = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "root", "n")), lists], ["id", "root", "n", "sets"])

    return run


def _block_links(table: pa.Table) -> pa.Table:
    """Of the nodes of two blocks (columns id, root, sets, own: of the first block), a spanning forest of the links between different roots."""
    ids, roots, own = (table.column(c).to_numpy() for c in ("id", "root", "own"))
    a, b = [], []
    if len(np.unique(roots)) > 1:
        lists = table.column("sets").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        at = at - at[0]
        sizes = np.diff(at)
        # the first block's shingles in order, with their owners
        mine = np.repeat(own, sizes)
        owner = np.repeat(np.arange(len(ids)), sizes)[mine]
        order = np.argsort(flat[mine], kind="stable")
        shingles, owner = flat[mine][order], owner[order]
        parent = {int(x): int(x) for x in roots}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for k in range(len(ids)):
            both = np.zeros(len(ids), np.int64)
            for c in range(at[k], at[k + 1], AT_ONCE):
                part = flat[c : min(c + AT_ONCE, at[k + 1])]
                low = np.searchsorted(shingles, part, "left")
                n = np.searchsorted(shingles, part, "right") - low
                both += np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(ids))
            for j in np.flatnonzero((both > 0) & (WHOLE * both >= PART * (sizes + sizes[k] - both))).tolist():
                x, y = find(int(roots[k])), find(int(roots[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(int(max(ids[k], ids[j])))
                    b.append(int(min(ids[k], ids[j])))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _prefix_pairs(many: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): which nodes of large buckets are in one cluster, each with the first of those with which its prefix shares a shingle."""
    found = sets.join(many.select("id").distinct(), "id", "left_semi").select("id", "root", "n", F.explode("sets").alias("s"))
    often = found.groupBy("s").agg(F.count("*").alias("m"), F.min("root").alias("least"), F.max("root").alias("most"))
    # of n shingles the rarest n - ceil(0.8 n) + 1; those that occur once come first and meet nothing
    often = often.where("m > 1").select("s", "m", (F.col("least") < F.col("most")).alias("mixed"))
    shared = found.join(often, "s").withColumn("_at", F.struct("m", "s"))
    single = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    place = single + F.row_number().over(Window.partitionBy("id").orderBy("_at"))
    prefix = F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1
    met = stored(shared.withColumn("_place", place).where((F.col("_place") <= prefix) & F.col("mixed")).select("id", "root", "s"), "near-prefixes")
    first = met.groupBy("s").agg(F.min("id").alias("b"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("s", "b")
    out = stored(met.join(first, "s").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "near-prefix-pairs")
    done_with(met)
    return out


def _dealt(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of clusters that are not all connected, once for each pair of blocks (c, lo, hi) that they are in. placed: (id, root, c), a node's cluster; sets: (id, sets).

    Clusters are cut before their nodes' shingles come in, by id: so it is the pair of blocks that deals these out to tasks, not the cluster.
    """
    sizes = placed.groupBy("c").agg(F.count("*").alias("m"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("c", "m")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    cut = placed.join(sizes, "c").withColumns({"k": blocks, "p": F.pmod(F.xxhash64("id", "c"), blocks).cast("int")})
    cut = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cut = cut.select("id", "root", "c", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") <= F.col("q")).alias("own"))
    return cut.join(sets, "id").select("id", "root", "sets", "c", "lo", "hi", "own")


def _cluster_links(few: DataFrame, many: DataFrame, narrow: DataFrame, words: int) -> DataFrame:
    """Links (a, b) among the members (key, id, root, n) of small and large buckets that are not all connected yet."""
    wanted = stored(few.union(many).select("id", "root", "n").distinct(), "near-wanted")
    # only the texts that are wanted are shuffled
    held = sifted(narrow, wanted.select(F.col("id").alias("_rid")), "_rid")
    texts = held.join(wanted, F.col("_rid") == F.col("id")).select("id", "root", "n", "text")
    sets = stored(texts.mapInArrow(_sets(words), "id bigint, root bigint, n int, sets array<bigint>"), "near-sets")
    lead = few.groupBy("key").agg(F.min("id").alias("b"))
    near = few.join(lead, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    far = _prefix_pairs(many, sets)
    cluster = components(near.union(far)).withColumnRenamed("root", "c")
    placed = stored(wanted.join(cluster, F.col("id") == F.col("node")).select("id", "root", "c"), "near-clusters")
    done_with(wanted, far)
    dealt = _dealt(placed, sets.select("id", "sets"))
    out = stored(dealt.groupBy("c", "lo", "hi").applyInArrow(_block_links, "a bigint, b bigint"), "near-links")
    done_with(placed, sets)
    return out


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * WHOLE >= F.greatest(n, m) * PART


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _links(pairs: DataFrame, nodes: DataFrame, narrow: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) of row ids whose texts are similar enough: by sketches first, then by texts."""
    one, other = (nodes.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    sketched = pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb")
    alike = stored(sketched.mapInArrow(_alike, "a bigint, b bigint"), "near-alike")
    ids = alike.select(F.col("a").alias("_rid")).union(alike.select("b")).distinct()
    texts = stored(sifted(narrow, ids, "_rid").join(ids, "_rid"), "near-texts")
    one, other = (texts.select(F.col("_rid").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    both = alike.join(one, "a").join(other, "b").select("a", "b", "ta", "tb")
    out = stored(both.mapInArrow(_compared(words), "a bigint, b bigint"), "near-links")
    done_with(alike, texts)
    return out


def _sim_links(docs: DataFrame, nodes_of: DataFrame, radius: int) -> DataFrame:
    """Operator 2's links (a, b), between nodes. nodes_of: (_rid, id), the node of each row."""
    found = near_duplicates(docs, radius=radius).where("_rid <> lead").select("_rid", "lead")
    lead = nodes_of.select(F.col("_rid").alias("lead"), F.col("id").alias("b"))
    return stored(found.join(nodes_of, "_rid").join(lead, "lead").where("id <> b").select(*_pair(F.col("id"), F.col("b"))).distinct(), "near-simhash")


def leads(docs: DataFrame, words: int = 5, radius: int = 2) -> DataFrame:
    """(_rid) of the rows that stay. docs must have _rid and doc_id. Of its own tables only that of these ids is left in the scratch folder."""
    narrow = docs.select("_rid", F.col("text").cast("string").alias("text"))
    made = narrow.mapInArrow(_signatures(words), "_rid bigint, high bigint, low bigint, n int, keys array<bigint>, sketch binary")
    made = stored(made, "near-signatures")
    nodes = made.groupBy("high", "low").agg(F.min("_rid").alias("id"), *(F.first(c).alias(c) for c in ("n", "keys", "sketch")))
    nodes = stored(nodes, "near-nodes")
    nodes_of = made.select("_rid", "high", "low").join(nodes.select("high", "low", "id"), ["high", "low"]).select("_rid", "id")
    same = _sim_links(docs, nodes_of, radius)
    done_with(made)
    keyed = nodes.select("id", "n", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(keyed.join(counts, "key"), "near-buckets")

    drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "n")).alias("c"))
    star = members.join(drawn, "key").where(F.col("id") != F.col("c.id")).where(_sizes_fit(F.col("n"), F.col("c.n")))
    pairs = stored(star.select(*_pair(F.col("id"), F.col("c.id"))).distinct(), "near-pairs")
    first = _links(pairs, nodes, narrow, words)

    roots = components(first.union(same))
    apart = members.join(roots, members.id == roots.node, "left").select("key", "id", "n", "m", F.coalesce("root", "id").alias("root"))
    rooted = stored(apart, "near-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    apart = stored(rooted.join(mixed, "key"), "near-apart")
    done_with(members, rooted, pairs)
    few, many = apart.where(F.col("m") <= SMALL), apart.where(F.col("m") > SMALL)
    columns = ["key", "id", "root", "n"]
    second = _cluster_links(few.select(*columns), many.select(*columns), narrow, words)
    done_with(apart)

    # what the first links have joined stands in its stars
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))
    lost = roots.where("node <> root").select(F.col("node").alias("id"))
    out = stored(nodes.join(lost, "id", "left_anti").select(F.col("id").alias("_rid")), "near-leads")
    done_with(nodes, first, same, second)
    return out


@keeps_columns
def one_of_each(docs: DataFrame, words: int = 5, radius: int = 2) -> DataFrame:
    """The rows of docs without those that are linked, over any steps, to a row before them."""
    numbered = with_row_ids(docs)
    return numbered.join(leads(numbered, words, radius), "_rid", "left_semi").select(*docs.columns)
