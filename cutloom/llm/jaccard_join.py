"""N-gram Jaccard self-join: an LSH forest of MinHash signatures, then exact verification.

1. A map over whole texts gives each a 128-bit key of its words and, for each of TREES tries, its path: MOST_DEPTH MinHash values of 16 bits,
   packed into two longs. Equal word sequences collapse to one representative with a count.
2. Two sets meet in a trie as far down as their paths agree. Sets that are alone even at the least depth in every trie meet nobody.
   The paths of the others are sorted in each trie, so the longest prefix that a set shares with any other is the one with a neighbour.
3. Sets start at the longest prefix: those of one whole path form groups. Then each set's prefix is shortened, as far as it must be: to the
   greatest depth at which the sets outside its group, by the total of the prefixes it shares with them, can't hide one of the threshold's
   similarity with more than the permitted probability. So dense groups and lone sets stay at the top depth, and sets in doubt go down,
   at most to the depth at which sets of the threshold's similarity meet in some trie with the target probability. A pair meets at a depth that
   neither of its sets has settled above. Connected components of these meetings hold every candidate pair.
4. A component's representatives are compared exactly by their shingle sets. A large component is dealt in
   chunks, and every two chunks meet in one group of bounded size; a group gives a count for each of its
   representatives and a spanning forest of its links, never the pairs. Where a large component hangs together
   loosely, so that fewer sets have to travel if each trie node (at the least depth) meets by itself, its nodes do instead; a pair that
   shares several then counts in the first.
5. Components of the verified links are the classes.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm import _words
from cutloom.llm._components import components
from cutloom.llm._tables import documents, materialize, picked

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
MOST_DEPTH = 8
RECALL = 0.999
CHUNK_SETS = 512
CHUNK_SHINGLES = 1_000_000
SLAB = 4096
MOST_HELD = 200_000
MEETS = "array<struct<root:long,tree:int,pa:long,pb:long,chunks:int>>"
U = np.uint64


def least_depth(threshold=THRESHOLD, trees=TREES, recall=RECALL, most=MOST_DEPTH) -> int:
    """The longest prefix at which sets of the threshold's similarity miss each other in all tries with at most half of the permitted probability; 1 at least."""
    depth = most
    while depth > 1 and (1 - threshold**depth) ** trees > (1 - recall) / 2:
        depth -= 1
    return depth


def settle_limits(threshold=THRESHOLD, trees=TREES, recall=RECALL, most=MOST_DEPTH) -> dict[int, int]:
    """For each depth above the least: up to which total of shared prefixes a set may settle there (-1: never).

    The length of the prefix that two sets of similarity s share in a trie is l with probability s**l * (1 - s). A set of the threshold's similarity
    that stays unmet at depth d shares less than d values in every trie, and in total no more than the set's neighbours outside its group
    do. The limit is the greatest total for which that has at most its part of the permitted probability: half, dealt over the depths and the pair's two sides.
    """
    least = least_depth(threshold, trees, recall, most)
    part = (1 - recall) / 2 / max(1, 2 * (most - least))
    limits = {}
    for d in range(least + 1, most + 1):
        one = np.array([threshold**x * (1 - threshold) for x in range(d)])
        total = np.ones(1)
        for _ in range(trees):
            total = np.convolve(total, one)
        limits[d] = int(np.searchsorted(np.cumsum(total), part, "right")) - 1
    return limits


def text_keys(h: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """128 bits for each row's sequence of words, as two arrays."""
    n = np.diff(rows)
    at = np.arange(len(h)) - np.repeat(rows[:-1], n)
    halves = []
    for seed in (0x1F, 0x2E):
        mixed = _words.mix(h + _words.mix(at.astype(U), seed) * U(2 * seed + 1), seed)
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(mixed, out=sums[1:])
        halves.append(_words.mix(sums[rows[1:]] - sums[rows[:-1]] + n.astype(U), seed + 1).view(np.int64))
    return halves


def paths(sh: np.ndarray, first: np.ndarray, trees: int) -> np.ndarray:
    """rows x (2 * trees): each trie's path, eight 16-bit MinHash values in two longs, the first value highest."""
    factors = np.random.default_rng(20).integers(1, 1 << 63, (trees, MOST_DEPTH), dtype=U) * U(2) + U(1)
    out = np.zeros((len(first) - 1, 2 * trees), U)
    for t in range(trees):
        for d in range(MOST_DEPTH):
            least = _words.min_per_row(_words.mix_light(sh * factors[t, d]), first, 0)
            side = 2 * t + (d >= 4)
            out[:, side] = out[:, side] << U(16) | _words.mix(least, t * MOST_DEPTH + d) >> U(48)
    return out


def _signed(batches, k: int, trees: int):
    for batch in batches:
        for s in _words.slices(batch.column(1)):
            w = _words.words(s)
            h = _words.word_hashes(s, w)
            sh, first = _words.shingles(h, w.rows, k)
            path = paths(sh, first, trees).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, path.size + 1, 2 * trees), pa.int32()), pa.array(path.ravel()))
            k1, k2 = text_keys(h, w.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(k1), pa.array(k2), pa.array(np.diff(first), pa.int64()), lists], ["doc_id", "k1", "k2", "n", "paths"])


def shared_depth(hi: np.ndarray, lo: np.ndarray, other_hi: np.ndarray, other_lo: np.ndarray) -> np.ndarray:
    """How many values paths begin with in common."""
    x, y = (hi ^ other_hi).view(U), (lo ^ other_lo).view(U)
    zeros = lambda z: sum((z >> U(k) == 0).astype(np.int8) for k in (48, 32, 16, 0))
    above = zeros(x)
    return above + np.where(above == 4, zeros(y), 0).astype(np.int8)


def _neighbours(batches):
    """Rows (tree, hi, lo, v, label) arrive sorted by trie and path. Gives v, tree, hi, lo, shared (the longest prefix shared with any other row of the trie) and foreign (with any row of another label).

    Both are exact but where the partition ends, or a run of one label is longer than MOST_HELD rows; there they are upper bounds, by rows nearer than the unseen one.
    """
    held, last, left = None, None, None
    names = ("tree", "hi", "lo", "v", "label")
    for batch in chain(batches, [None]):
        rows = [batch.column(c).to_numpy() for c in names] if batch is not None else [np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 4]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        tree, hi, lo, v, label = rows
        n = len(v)
        if not n:
            continue
        starts = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (label[1:] != label[:-1])))
        stop = n if batch is None or starts[-1] == 0 and n > MOST_HELD else starts[-1]
        held = [x[stop:] for x in rows]
        if not stop:
            continue
        if last is None:
            left = (tree[0], hi[0], lo[0])  # the row before the partition shares no more than the first one does
        elif (tree[0], label[0]) != (last[0], last[3]):
            left = last[:3]
        run = np.searchsorted(starts, np.arange(stop), "right") - 1
        after = np.append(starts[1:], n)[run]
        after = np.where(after < n, after, stop - 1)
        before = np.maximum(starts[run] - 1, 0)
        near = [np.where(run == 0, edge, x[before]) for edge, x in zip(left, (tree, hi, lo), strict=True)]
        here = (hi[:stop], lo[:stop])
        foreign = np.maximum(
            np.where(near[0] == tree[:stop], shared_depth(*here, near[1], near[2]), 0),
            np.where(tree[after] == tree[:stop], shared_depth(*here, hi[after], lo[after]), 0),
        )
        gaps = np.where(tree[1:] == tree[:-1], shared_depth(hi[1:], lo[1:], hi[:-1], lo[:-1]), 0)
        first_gap = MOST_DEPTH if last is None else shared_depth(hi[:1], lo[:1], np.array([last[1]]), np.array([last[2]]))[0] * (last[0] == tree[0])
        gaps = np.concatenate([[first_gap], gaps, [MOST_DEPTH]])
        shared = np.maximum(gaps[:stop], gaps[1 : stop + 1])
        last = (tree[stop - 1], hi[stop - 1], lo[stop - 1], label[stop - 1])
        left = tuple(x[-1] for x in near)
        columns = [pa.array(v[:stop]), pa.array(tree[:stop], pa.int32()), pa.array(hi[:stop]), pa.array(lo[:stop]), pa.array(shared, pa.int32()), pa.array(foreign, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["v", "tree", "hi", "lo", "shared", "foreign"])


def _text_keyed(batches, at: int):
    """The rows with their text's key and number of words."""
    for batch in batches:
        k1, k2, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in _words.slices(batch.column(at)):
            w = _words.words(s)
            for out, key in zip((k1, k2), text_keys(_words.word_hashes(s, w), w.rows), strict=True):
                out.append(key)
            n.append(w.counts())
        more = [pa.array(np.concatenate(x).astype(np.int64)) for x in (k1, k2, n)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "k1", "k2", "n"])


def _shingled(batches, k: int):
    """The texts' distinct shingles, sorted. Repeated rows of one text arrive together, and one stays."""
    last = -1
    for batch in batches:
        v = batch.column("v").to_numpy()
        new = np.concatenate([[last], v[:-1]])[: len(v)] != v
        last = v[-1] if len(v) else last
        batch = batch.filter(pa.array(new))
        for s in _words.slices(batch.column(0)):
            w = _words.words(s)
            h = _words.word_hashes(s, w)
            sh, first = _words.shingles(h, w.rows, k)
            sets = [np.unique(sh[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            rest = batch.slice(s.first, s.rows).select(batch.schema.names[1:])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], [*rest.schema.names, "sh"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right: products of 0/1 matrices, SLAB elements at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for flat, sets in ((a, left), (b, right)):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, flat)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == flat[hit]
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], owner[hit][order]))
    for low in range(0, len(common), SLAB):
        width = min(SLAB, len(common) - low)
        slabs = []
        for (at, owner), sets in zip(sides, (left, right), strict=True):
            x, y = np.searchsorted(at, [low, low + width])
            slab = np.zeros((len(sets), width), np.float32)
            slab[owner[x:y], at[x:y] - low] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[1].T
    return out


def _links(keys: list[int], chunks: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float, i: int, j: int, earlier: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """For each set of a meeting of chunks i and j: how many documents of the other chunk (of its own, if i = j) it links to, and the least key it hangs together with here.

    earlier: sets x tries x 2, each set's prefixes in the tries before the meeting's own; pairs that share one of them count there.
    """
    size = np.array([len(x) for x in sets])
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    counts = np.zeros(len(keys), np.int64)
    left, right = np.flatnonzero(chunks == i), np.flatnonzero(chunks == j)
    if len(left) and len(right):
        shared = overlaps([sets[x] for x in left], [sets[x] for x in right]).astype(np.float64)
        linked = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        if earlier is not None:
            for t in range(earlier.shape[1]):
                linked &= (earlier[left, t][:, None] != earlier[right, t][None, :]).any(axis=2)
        counts[left] += linked @ copies[right]
        if i != j:
            counts[right] += linked.T @ copies[left]
        for x, row in zip(left.tolist(), linked, strict=True):
            for y in right[np.flatnonzero(row)].tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return counts, [keys[find(x)] for x in range(len(keys))]


def _cut(path: np.ndarray, depth: int) -> np.ndarray:
    """... x 2 paths with all values after the first ``depth`` set to 0."""
    masks = [(1 << 64) - (1 << 16 * (4 - min(depth, 4))), (1 << 64) - (1 << 16 * (8 - max(depth, 4)))]
    return path & np.array(masks, U).view(np.int64)


def _verified(batches, threshold: float, least: int):
    """Rows arrive sorted by meeting: each run of equal (root, tree, pa, pb, i, j) is one, and is held alone."""
    held: list[tuple] = []
    out: list[tuple] = []
    now = None

    def close():
        if not held:
            return
        held.sort(key=lambda r: r[0])
        keys, tree = [r[0] for r in held], now[1]
        earlier = _cut(np.array([r[4][: 2 * tree] for r in held], np.int64).reshape(len(held), tree, 2), least) if tree > 0 else None
        counts, lowest = _links(keys, np.array([r[1] for r in held]), np.array([r[2] for r in held], np.int64), [r[3] for r in held], threshold, now[4], now[5], earlier)
        out.extend(zip(keys, counts.tolist(), lowest, strict=True))
        held.clear()

    def batch_out():
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["v", "links", "least"])
        out.clear()
        return done

    for batch in batches:
        values, ends = batch.column("sh").values.to_numpy(zero_copy_only=False), batch.column("sh").offsets.to_numpy()
        meeting = zip(*[batch.column(c).to_pylist() for c in MEETING], strict=True)
        for at, (place, v, chunk, copies, path) in enumerate(zip(meeting, *[batch.column(c).to_pylist() for c in ("v", "chunk", "copies", "paths")], strict=True)):
            if place != now:
                close()
                now = place
            if not any(v == r[0] for r in held[-1:]):  # repeated rows of one document stand together
                held.append((v, chunk, copies, values[ends[at] : ends[at + 1]].copy(), path))
        yield batch_out()
    close()
    yield batch_out()


MEETING = ("root", "tree", "pa", "pb", "i", "j")


def _prefix(depth) -> list:
    """Columns pa and pb: the first ``depth`` (a number or a column's name) values of hi and lo."""
    return [F.expr(f"shiftrightunsigned(hi, 16 * (4 - least({depth}, 4)))").alias("pa"), F.expr(f"CASE WHEN {depth} > 4 THEN shiftrightunsigned(lo, 16 * (8 - {depth})) ELSE 0L END").alias("pb")]


def _tried(reps: DataFrame, *also: str) -> DataFrame:
    """v, tree, hi, lo of every representative's path in every trie, and the columns named."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size("paths") / 2 - 1).cast("int")), lambda t: F.struct(F.get("paths", 2 * t).alias("hi"), F.get("paths", 2 * t + 1).alias("lo")))
    return reps.select("v", *also, F.posexplode(pairs).alias("tree", "path")).select("v", "tree", "path.*", *also)


def forest(reps: DataFrame, threshold=THRESHOLD, recall=RECALL, trees=TREES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of representatives (v, paths): who meets whom.

    depths: v, depth (at which the set settled) for the sets that share a prefix of the least depth with another. edges: v, hub, two sets that
    meet. shared: v, tree, pa, pb, the nodes of the least depth that hold two sets or more.
    """
    least, limits = least_depth(threshold, trees, recall), settle_limits(threshold, trees, recall)
    every = _tried(reps)
    at_least = every.select("v", "tree", "hi", "lo", *_prefix(least))
    nodes = materialize(at_least.groupBy("tree", "pa", "pb").agg(F.count("*").alias("many")).filter("many > 1").drop("many"), "nodes")  # tables, so that a hot node is a join Spark can split
    shared = materialize(at_least.join(nodes, ["tree", "pa", "pb"]), "shared-nodes")
    whole = shared.groupBy("tree", "hi", "lo").agg(F.min("v").alias("label"), F.count("*").alias("many")).filter("many > 1").drop("many")
    grouped = shared.select("v", "tree", "hi", "lo").join(materialize(whole, "whole-paths"), ["tree", "hi", "lo"]).groupBy("v").agg(F.min("label").alias("label"))
    alive = shared.select("v").distinct().join(materialize(grouped, "groups"), "v", "left")
    alive = reps.select("v", "paths").join(materialize(alive, "alive").withColumnRenamed("v", "of"), F.col("v") == F.col("of"))
    labelled = alive.select("v", "paths", F.coalesce("label", "v").alias("label"))
    tries = _tried(labelled, "label")
    tries = tries.repartitionByRange("tree", "hi", "lo", "v").sortWithinPartitions("tree", "hi", "lo", "v")
    tries = materialize(tries.mapInArrow(_neighbours, "v long, tree int, hi long, lo long, shared int, foreign int"), "tries")
    depth = F.lit(least)
    for d, limit in limits.items():
        depth = F.when(F.col(f"foreign_{d}") <= limit, d).otherwise(depth)
    totals = tries.groupBy("v").agg(*[F.sum(F.least("foreign", F.lit(d - 1))).alias(f"foreign_{d}") for d in limits]) if limits else tries.select("v").distinct()
    depths = materialize(totals.select("v", depth.alias("depth")), "depths")
    met = tries.filter(F.col("shared") >= least).join(depths, "v").filter("shared >= depth")
    met = met.select("v", "tree", "hi", "lo", F.explode(F.sequence("depth", "shared")).alias("at")).select("v", "tree", "at", *_prefix("at"))
    met = materialize(met, "met")
    hubs = materialize(met.groupBy("tree", "at", "pa", "pb").agg(F.min("v").alias("hub"), F.count("*").alias("many")).filter("many > 1").drop("many"), "hubs")
    return depths, met.join(hubs, ["tree", "at", "pa", "pb"]).select("v", "hub"), shared


def _meetings(members: DataFrame, shared: DataFrame) -> DataFrame:
    """v, meets: where each representative is compared, as (root, tree, pa, pb, chunks).

    A component of n members in c chunks sends n * c sets around; its nodes of the least depth, each dealt by itself, send the sum of the same
    product over them. The lesser decides, for components of more than one chunk. A component that meets as a whole has tree -1.
    """
    c = F.col
    rate = F.greatest(F.lit(1 / CHUNK_SETS), F.avg("n") / CHUNK_SHINGLES)
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), rate.alias("rate"))
    sizes = materialize(sizes.withColumn("chunks", F.ceil(c("size") * c("rate")).cast("int")), "sizes")
    large = members.select("v", "root").join(sizes.filter("chunks > 1"), "root")
    rooted = materialize(shared.select("v", "tree", "pa", "pb").join(large, "v"), "rooted")
    parts = rooted.groupBy("root", "tree", "pa", "pb").agg(F.count("*").alias("many"), F.first("rate").alias("rate"), F.first("size").alias("size"), F.first("chunks").alias("chunks")).filter("many > 1")
    parts = materialize(parts.withColumn("parts", F.ceil(c("many") * c("rate")).cast("int")), "parts")
    loose = parts.groupBy("root").agg(F.sum(c("many") * c("parts")).alias("sent"), F.first("size").alias("size"), F.first("chunks").alias("chunks"))
    loose = materialize(loose.filter(c("sent") < c("size") * c("chunks")).select("root", F.lit(True).alias("loose")), "loose")
    whole = members.select("v", "root").join(sizes, "root").join(loose, "root", "left").filter("loose is null")
    meet = lambda chunks, tree, *at: F.struct("root", tree.alias("tree"), *[x.alias(n) for x, n in zip(at, ("pa", "pb"), strict=True)], chunks.alias("chunks"))
    whole = whole.select("v", F.array(meet(c("chunks"), F.lit(-1), F.lit(0).cast("long"), F.lit(0).cast("long"))).alias("meets"))
    each = rooted.select("v", "root", "tree", "pa", "pb").join(parts.join(loose, "root").select("root", "tree", "pa", "pb", "parts"), ["root", "tree", "pa", "pb"])
    return whole.unionByName(each.groupBy("v").agg(F.collect_list(meet(c("parts"), c("tree"), c("pa"), c("pb"))).alias("meets")))


def _classified(known: DataFrame, kind: str, k: int, threshold: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Of known (doc_id, text; no null ids): signed, each row's (doc_id, k1, k2, n), and per text (k1, k2, rep_id, n_links, n_copies, root), the texts of one class having one root."""
    c = F.col
    signed = materialize(known.mapInArrow(lambda b: _signed(b, k, trees), f"doc_id {kind}, k1 long, k2 long, n long, paths array<long>"), "signed")
    reps = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("paths").alias("paths"))
    reps = materialize(reps.withColumn("v", F.monotonically_increasing_id()), "reps")
    _, edges, shared = forest(reps, threshold, recall, trees)
    found = components(edges.select(c("v").alias("u"), c("hub").alias("v")))
    members = found.unionByName(found.select(c("root").alias("u"), "root").distinct()).withColumnRenamed("u", "of")
    members = materialize(reps.join(members, c("v") == c("of")).drop("of"), "members")
    meets = _meetings(members, shared).withColumnRenamed("v", "of")
    asked = members.select("k1", "k2", "v", "rep_id", "copies", "paths").join(meets, c("v") == c("of")).drop("of")
    keyed = known.mapInArrow(lambda b: _text_keyed(b, 1), f"doc_id {kind}, text string, k1 long, k2 long, n long").drop("n")
    asked = asked.withColumnRenamed("rep_id", "doc_id").hint("merge")  # by id and text, so an id of many texts is as many keys
    texts = keyed.join(asked, ["doc_id", "k1", "k2"]).select("text", "v", "copies", "paths", "meets")
    sets = texts.mapInArrow(lambda b: _shingled(b, k), f"v long, copies long, paths array<long>, meets {MEETS}, sh array<long>")
    meeting = sets.select("v", "copies", "sh", "paths", F.explode("meets").alias("m")).withColumn("chunk", F.pmod(F.xxhash64("v"), c("m.chunks")).cast("int"))
    meeting = meeting.withColumn("other", F.explode(F.sequence(F.lit(0), c("m.chunks") - 1)))
    place = [c(f"m.{x}").alias(x) for x in MEETING[:4]]
    meeting = meeting.select(*place, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "v", "chunk", "copies", F.when(c("m.tree") > 0, c("paths")).alias("paths"), "sh")
    least = least_depth(threshold, trees, recall)
    together = meeting.repartition(*MEETING).sortWithinPartitions(*MEETING, "v")
    verified = materialize(together.mapInArrow(lambda b: _verified(b, threshold, least), "v long, links long, least long"), "verified")
    links = verified.groupBy("v").agg(F.sum("links").alias("links"))
    classes = components(verified.select(c("v").alias("u"), c("least").alias("v")))
    per_text = reps.select("k1", "k2", "v", "rep_id", "copies").join(links, "v", "left").join(classes.withColumnRenamed("u", "v"), "v", "left")
    per_text = per_text.select("k1", "k2", "rep_id", (F.coalesce("links", F.lit(0)) + c("copies") - 1).alias("n_links"), (c("copies") - 1).alias("n_copies"), F.coalesce("root", "v").alias("root"))
    return signed, materialize(per_text, "per-text")


def jaccard_classes(docs: DataFrame, id_col="doc_id", text_col="text", k=SHINGLE, threshold=THRESHOLD, trees=TREES, recall=RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row per input row.

    n_links counts the other rows whose set of k-word shingles has Jaccard similarity threshold or more,
    copies among them; class_id is the least id that such links lead to, its own if none; n_copies counts
    the other rows of the same words. Words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than k words has one
    shingle, all of them. Null, empty and blank texts link to nothing. Rows with a null id take no part: class_id null, no links. Repeated rows are copies.
    Pairs at the threshold are found with probability ``recall`` each at least, more similar ones more surely;
    no pair below it is ever linked. An empty table gives an empty table; other columns are ignored.
    """
    c = F.col
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = rows.filter("doc_id is not null")
    signed, per_text = _classified(known, kind, k, threshold, trees, recall)
    lowest = materialize(per_text.groupBy("root").agg(F.min("rep_id").alias("class_id")), "class-ids")
    named = per_text.join(lowest, "root").select("k1", "k2", "class_id", "n_links", "n_copies")
    linked = signed.filter("n > 0").select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "n_copies")
    none = F.lit(0).cast("long")
    blank = signed.filter("n = 0").select("doc_id", c("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies"))
    unknown = rows.filter("doc_id is null").select("doc_id", F.lit(None).cast(kind).alias("class_id"), none.alias("n_links"), none.alias("n_copies"))
    return linked.unionByName(blank).unionByName(unknown)


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", k=SHINGLE, threshold=THRESHOLD, trees=TREES, recall=RECALL) -> DataFrame:
    """docs with one row of each class: of its least id, and of that id's texts in the class one. Columns unchanged.

    A row is known by its id and its words, so rows of one id are in as many classes as their texts, and each text that nothing else has stays.
    Rows with a null id or a blank text all stay.
    """
    names = docs.columns
    tidy = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, at = f"c{names.index(id_col)}", names.index(text_col)
    keyed = tidy.mapInArrow(lambda b: _text_keyed(b, at), ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ", k1 long, k2 long, n long")
    known = picked(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")
    _, per_text = _classified(known, known.schema["doc_id"].dataType.simpleString(), k, threshold, trees, recall)
    first = per_text.groupBy("root").agg(F.min(F.struct("rep_id", "k1", "k2")).alias("first")).select(F.col("first.rep_id").alias(ident), "first.k1", "first.k2")
    worded = (F.col("n") > 0) & F.col(ident).isNotNull()
    kept = keyed.filter(worded).join(materialize(first, "kept").hint("merge"), [ident, "k1", "k2"], "left_semi").dropDuplicates([ident, "k1", "k2"])
    return kept.unionByName(keyed.filter(~worded)).select(*tidy.columns).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


#: Every pair of texts that share a shingle, counted exactly: for tables of some thousand documents.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach(doc_id, other) AS (SELECT a, a FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
degree AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
copies AS (SELECT doc_id, CASE WHEN len(ws) > 0 THEN count(*) OVER (PARTITION BY array_to_string(ws, ' ')) - 1 ELSE 0 END AS n_copies FROM w)
SELECT c.doc_id, coalesce(class_id, c.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, n_copies FROM copies c LEFT JOIN class USING (doc_id) LEFT JOIN degree USING (doc_id)
"""
