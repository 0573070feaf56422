"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its 5-word shingles. Equal sets become one node first.
Each of ``TREES`` independent trees deals the nodes by one minwise token; a tree
node of at most ``LEAF`` members is compared exhaustively, a larger one branches
again by one or two other minwise tokens chosen for it, ``BRANCHING`` on average,
down to ``DEPTH`` levels. Within a leaf, minwise tokens pick the members that may
have a partner; equal groups from several trees are kept once; and every pair of
a group is then decided on the full sets.

Groups that agree less than 1 / ``BRANCHING`` shrink faster than they multiply, so
the work stays in proportion. Of links at the threshold, 85 in 100 meet in one
tree where nodes are small, and about half where a node takes six more levels:
ten trees find 0.99999 and 0.999 of them.

A larger node whose members agree with each other in more than ``DENSE`` of their
tokens is no longer branched, since that would cost more than it saves; nor is one
that is down to ``WIDE`` leaves after ``DEPTH`` levels. Others go on, with tokens
that are new to their path. What is set apart so is one dense group for all trees
whose most typical members, the hubs, are shared. All members are compared with
the hub on the full sets. Those linked to it are one component; the others are
compared with all members in cells of two blocks, each pair of blocks once.

Defined cases: a document with fewer words than a shingle has its whole sequence
as the only element. Without words, or with a null text, the set is empty,
n_shingles is 0 and there are no links. A row without id belongs to the
documents with its set, as a link needs an id; its component_id is null if none
of them has one. Rows may repeat. Extra columns are carried by
``drop_near_copies`` only. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treeshift.llm.common import chunks, in_keys, join_unique, lists, runs, spare_name, staged, text_bytes

SHINGLE = 5
SKETCH = 64
TREES = 10
LEAF = 1024
DEPTH = 12
BRANCHING = 1.25
#: Mean share of tokens that agree with the commonest ones, above which branching does not pay.
DENSE = 0.88
#: Leaves that a node may have to be compared in cells once it took ``DEPTH`` levels.
WIDE = 16
#: Members of a large node that are looked at to tell whether it is dense.
SEEN = 64
#: Least similarity of a link, in percent, that BRANCHING, TREES and LIKELY are made for.
LOWEST = 85
#: Below this share of common minwise tokens a pair cannot have that similarity (four deviations).
LIKELY = 0.66

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)

_BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(2024)
_FACTOR = _random.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASK = _random.integers(0, 1 << 32, SKETCH, dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse."""

    def run(base: int) -> np.ndarray:
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    found: list[np.ndarray] = []
    for first, last in chunks(texts):
        data = np.frombuffer(b"\n" + b"\n".join(texts[first:last]) + b"\n", dtype=np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts[first:last]])
        power, inverse = _powers(max(1 << 21, 1 << int(len(data)).bit_length()))
        space = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        total = np.cumsum(_LOWER[data] * power[: len(data)])
        words = _mixed((total[ends - 1] - total[starts - 1]) * inverse[starts])
        bounds = np.searchsorted(starts, np.concatenate([[0], ends_of]))
        if len(words) >= SHINGLE:
            width = len(words) - SHINGLE + 1
            grams = words[:width].copy()
            for k in range(1, SHINGLE):
                grams = _mixed(grams) + words[k : k + width]
            grams = _mixed(grams)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                found.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:
                short = np.full(1, b - a, dtype=np.uint64)
                for k in range(a, b):
                    short = _mixed(short) + words[k : k + 1]
                found.append(_mixed(short))
            else:
                found.append(np.zeros(0, np.uint64))
    return found


def _identity(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` minwise tokens of a set."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(least, ((short[None, i : i + 2048] ^ _MASK[:, None]) * _FACTOR[:, None]).min(axis=1), out=least)
    return least.view(np.int32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(text_bytes(batch.column("text")))
        rows = [sketch(s) for s in sets]
        tokens = pa.ListArray.from_arrays(
            pa.array(np.arange(0, SKETCH * len(sets) + 1, SKETCH), pa.int32()),
            pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()),
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_identity(s) for s in sets], pa.binary()),
                tokens,
            ],
            ["doc_id", "n_shingles", "node", "tokens"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null if empty) and minwise tokens of each row."""
    schema = "doc_id long, n_shingles long, node binary, tokens array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, schema)


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (path, node, ...) of leaves and of larger tree nodes, and the sizes of these.

    A member that is alone in its tree node is in neither.
    """
    rows = staged(rows, "tree")
    sizes = staged(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "tree-sizes")
    small, large = sizes.filter(F.col("size") <= LEAF), sizes.filter(F.col("size") > LEAF)
    return in_keys(rows, small, "path", "size"), in_keys(rows, large, "path", "size"), large


def _typical(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """path, size, density and commonest tokens of each large node, from at most ``SEEN`` of its members.

    This only steers how a node is gone through, not what is compared.
    """
    drawn = F.xxhash64("path", "node", F.lit("seen"))
    seen = held.groupBy("path", F.pmod(drawn, F.lit(SEEN)).alias("slot")).agg(F.min_by("tokens", drawn).alias("tokens"))
    each = seen.select("path", F.posexplode("tokens").alias("at", "token"))
    votes = each.groupBy("path", "at", "token").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("path", "at").agg(
        F.max_by("token", F.struct("votes", "token")).alias("token"), (F.max("votes") / F.sum("votes")).alias("share")
    )
    facts = best.groupBy("path").agg(
        F.avg("share").alias("density"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("common"),
    )
    return facts.join(sizes, "path")


def leaves(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(path, node) for all members of leaves with two members or more, and (path, node, agrees) for dense nodes."""
    tokens = nodes.select("node", "tokens")
    roots = nodes.select("node", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token"))
    # a bit for each of the tokens that a path has used
    first = roots.select(F.xxhash64("tree", "token").alias("path"), "node", F.lit(0).cast("long").alias("used"))
    small, large, sizes = _dealt(first)
    found, dense, level = [small.select("path", "node")], [], 0
    while not sizes.isEmpty():
        held = staged(large.join(tokens, "node"), "tree-large")
        facts = staged(_typical(held, sizes), "tree-typical")
        apart = F.col("density") > DENSE
        if level >= DEPTH:
            apart |= F.col("size") <= WIDE * LEAF
        if level >= SKETCH - TREES:
            apart = F.lit(True)
        marked = join_unique(held, facts.withColumn("apart", apart), "path", "size")
        agrees = F.aggregate(F.zip_with("tokens", "common", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
        dense.append(staged(marked.filter("apart").select("path", "node", agrees.alias("agrees")), "tree-dense"))
        second = F.pmod(F.xxhash64("path", F.lit("second"), F.lit(level)), F.lit(1000)) < 1000 * (BRANCHING - 1)
        ways = F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        free = F.expr(f"filter(sequence({TREES}, {SKETCH - 1}), i -> (shiftright(used, i - {TREES}) & 1) = 0)")
        choice = F.element_at("free", (F.pmod(F.xxhash64("path", F.lit(level), "branch"), F.size("free")) + 1).cast("int"))
        branches = (
            marked.filter("NOT apart")
            .withColumn("branch", F.explode(ways))
            .withColumn("free", free)
            .withColumn("choice", choice)
            .select(
                F.xxhash64("path", "branch", F.element_at("tokens", F.col("choice") + 1)).alias("path"),
                "node",
                F.expr(f"used | shiftleft(1L, choice - {TREES})").alias("used"),
            )
        )
        small, large, sizes = _dealt(branches)
        found.append(small.select("path", "node"))
        level += 1
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    return union(found), staged(union(dense), "dense") if dense else None


def _dense_groups(dense: DataFrame) -> DataFrame:
    """(part, node, hub) of dense nodes; nodes of several trees whose hubs are typical of one another are one group."""
    hubs = staged(dense.groupBy("path").agg(F.max_by("node", F.struct("agrees", "node")).alias("hub"), F.max("agrees").alias("most")), "hubs")
    meet = hubs.select(F.col("path").alias("a"), F.col("hub").alias("node")).join(
        dense.filter(F.col("agrees") >= DENSE * SKETCH).select(F.col("path").alias("b"), "node"), "node"
    )
    one = components(meet.filter("a != b").select("a", "b")).select(F.col("node").alias("path"), "root")
    named = hubs.join(one, "path", "left").withColumn("part", F.coalesce("root", "path"))
    chosen = named.groupBy("part").agg(F.max_by("hub", F.struct("most", "hub")).alias("hub"))
    paths = named.select("path", "part").join(chosen, "part")
    sizes = dense.groupBy("path").agg(F.count(F.lit(1)).alias("size")).join(paths, "path")
    return staged(join_unique(dense.select("path", "node"), staged(sizes, "dense-sizes"), "path", "size").select("part", "node", "hub").distinct(), "dense-groups")


def _hub_links(percent: int):
    """Per batch of members and their hub, the members linked to it, decided on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for star in runs(batches, "star"):
            members, hubs = star.column("node").to_pylist(), star.column("hub").to_pylist()
            values, offsets = lists(star.column("hashes"), "int64")
            sets = [values[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]
            hub = sets[members.index(hubs[0])]
            linked = []
            for node, own in zip(members, sets):
                both = len(np.intersect1d(own, hub, assume_unique=True))
                if node != hubs[0] and 100 * both >= percent * (len(own) + len(hub) - both):
                    linked.append(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(linked, pa.binary()), pa.array(hubs[: len(linked)], pa.binary()), pa.array(star.column("part").to_pylist()[: len(linked)], pa.int64())],
                ["a", "b", "part"],
            )

    return run


def _stars(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(star, part, node, hub): dense groups in batches of about half a leaf, each with its hub."""
    batch = F.pmod(F.xxhash64("node", F.lit("star")), F.ceil(F.col("size") / (LEAF // 2)))
    dealt = join_unique(groups, sizes, "part", "size").withColumn("star", F.xxhash64("part", batch))
    rows = dealt.filter("node != hub").select("star", "part", "node", "hub")
    return rows.unionByName(dealt.select("star", "part", F.col("hub").alias("node"), "hub").distinct())


def _cells(groups: DataFrame, linked: DataFrame) -> DataFrame:
    """(path, node): the members that are not linked to their hub with all members, block by block."""
    own = linked.select("part", F.col("a").alias("node"), F.lit(False).alias("loose"))
    marked = staged(
        groups.join(own, ["part", "node"], "left").select(
            "part", "node", (F.coalesce("loose", F.lit(True)) & (F.col("node") != F.col("hub"))).alias("loose")
        ),
        "dense-marked",
    )
    half = LEAF // 2
    counts = marked.groupBy("part").agg(
        F.count(F.lit(1)).alias("size"), F.ceil(F.count_if("loose") / half).alias("apart"), F.ceil(F.count_if(~F.col("loose")) / half).alias("joined")
    )
    rows = join_unique(marked, staged(counts, "dense-counts"), "part", "size").filter("apart > 0")
    block = F.when(F.col("loose"), F.pmod(F.xxhash64("node", F.lit("block")), F.col("apart"))).otherwise(
        F.col("apart") + F.pmod(F.xxhash64("node", F.lit("block")), F.col("joined"))
    )
    # a linked member needs no other linked one: they are one component
    others = F.when(F.col("loose"), F.col("apart") + F.col("joined")).otherwise(F.col("apart"))
    met = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    return met.select(F.xxhash64("part", F.lit("cell"), F.least("block", "other"), F.greatest("block", "other")).alias("path"), "node")


def _dense_links(docs: DataFrame, named: DataFrame, dense: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of dense groups to their hubs, and the cells (path, node) that are still to be compared."""
    groups = _dense_groups(dense)
    sizes = staged(groups.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "dense-sizes")
    wanted = staged(named.select("node", "doc_id").join(groups.select("node"), "node", "left_semi"), "dense-wanted")
    stars = _stars(groups, sizes).join(_full_sets(docs, wanted), "node").select("star", "part", "node", "hub", "hashes")
    sorted_stars = stars.repartition("star").sortWithinPartitions("star")
    linked = staged(sorted_stars.mapInArrow(_hub_links(percent), "a binary, b binary, part long"), "hub-links")
    return linked.select("a", "b"), _cells(groups, linked)


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component in a symmetric matrix of links."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            edge = np.array([i])
            label[i] = i
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & (label < 0))
                label[edge] = i
    return label


def _likely(tokens: np.ndarray) -> np.ndarray:
    """Which pairs of rows agree in enough minwise tokens."""
    return np.array([(tokens == row).sum(axis=1) >= LIKELY * SKETCH for row in tokens])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per leaf, the groups of members that likely pairs connect."""
    groups, nodes = [], []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(groups, pa.binary()), pa.array(nodes, pa.binary())], ["part", "node"])
        groups.clear()
        nodes.clear()
        return out

    for leaf in runs(batches, "path"):
        members = leaf.column("node").to_pylist()
        tokens, _ = lists(leaf.column("tokens"), "int32")
        label = _components(_likely(tokens.reshape(len(members), SKETCH)))
        parts: dict[int, list[bytes]] = {}
        for i, root in enumerate(label.tolist()):
            parts.setdefault(root, []).append(members[i])
        for part in parts.values():
            if len(part) > 1:
                name = hashlib.blake2b(b"".join(sorted(part)), digest_size=16).digest()
                groups += [name] * len(part)
                nodes += part
        if len(nodes) > 20_000:
            yield flush()
    yield flush()


def linked_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of all pairs with 100 * intersection >= percent * union, decided on the full sets.

    Hashes that occur in one set only cannot be common; the others become bits.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[shared]]
    flags = np.zeros((len(sets), -(-int((count > 1).sum()) // 64) * 64), dtype=bool)
    flags[owner[shared], column] = True
    packed = np.packbits(flags, axis=1).view(np.uint64)
    sizes = np.array([len(s) for s in sets])
    linked = np.empty((len(sets), len(sets)), dtype=bool)
    for i, row in enumerate(packed):
        both = np.bitwise_count(packed & row).sum(axis=1, dtype=np.int64)
        linked[i] = 100 * both >= percent * (sizes + sizes[i] - both)
    return linked


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "part"):
            members = group.column("node").to_pylist()
            values, offsets = lists(group.column("hashes"), "int64")
            sets = [values[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]
            label = _components(linked_sets(sets, percent)).tolist()
            links = [(members[i], members[root]) for i, root in enumerate(label) if i != root]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"]
            )

    return run


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted (doc_id, node), shingled again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_identity(s) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "hashes"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    # an id may be used twice; only the rows with the wanted set count
    sets = texts.mapInArrow(run, "node binary, hashes array<long>")
    return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all ends of links (a, b): the least node that links lead to.

    Every round each node takes the least root among its neighbours and then
    that root's root, so chains shrink by half; rounds are written tables.
    """
    edges = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = staged(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "roots")
    while True:
        around = edges.join(roots.withColumnsRenamed({"node": "b", "root": "near"}), "b").groupBy(F.col("a").alias("node"))
        lower = roots.join(around.agg(F.min("near").alias("near")), "node").select(
            "node", "root", F.least("root", "near").alias("next")
        )
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        moved = staged(lower.join(jump, "next").select("node", "root", F.least("next", "beyond").alias("new")), "roots")
        roots = moved.select("node", F.col("new").alias("root"))
        if moved.filter("new < root").isEmpty():
            return roots


def near_groups(docs: DataFrame, percent: int = LOWEST) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    ``percent`` is the similarity of a link, ``LOWEST`` at least: the trees and the
    bound on common minwise tokens are made for it and find every higher one.
    """
    if percent < LOWEST:
        raise ValueError(f"links below {LOWEST} % would be lost")
    signed = staged(signatures(docs), "signatures")
    nodes = staged(
        signed.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens")),
        "nodes",
    )
    named = nodes.filter("doc_id IS NOT NULL")
    members, dense = leaves(named)
    to_hubs = None
    if dense is not None and not dense.isEmpty():
        to_hubs, cells = _dense_links(docs, named, dense, percent)
        members = members.unionByName(cells)
    by_path = members.join(named.select("node", "tokens"), "node").repartition("path").sortWithinPartitions("path")
    candidates = staged(by_path.mapInArrow(_candidates, "part binary, node binary").distinct(), "candidates")
    wanted = staged(named.select("node", "doc_id").join(candidates.select("node"), "node", "left_semi"), "wanted")
    with_sets = candidates.join(_full_sets(docs, wanted), "node").repartition("part").sortWithinPartitions("part")
    links = staged(with_sets.mapInArrow(_links(percent), "a binary, b binary"), "found")
    roots = components(links if to_hubs is None else links.unionByName(to_hubs))
    linked = staged(nodes.select("node", "doc_id").join(roots, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    grouped = join_unique(linked, staged(least, "components"), "root", "members").select("node", "component_id")
    known = staged(
        nodes.select("node", "doc_id", "copies")
        .join(grouped, "node", "left")
        .select("node", "copies", F.coalesce("component_id", "doc_id").alias("component_id")),
        "node-components",
    )
    rows = signed.select("doc_id", "n_shingles", "node")
    full = join_unique(rows.filter("node IS NOT NULL"), known, "node", "copies")
    empty = rows.filter("node IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return (
        full.select(columns)
        .unionByName(empty.select(columns))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def drop_near_copies(docs: DataFrame, percent: int = LOWEST) -> DataFrame:
    """``docs`` without the rows that are near copies of a row with a smaller id."""
    name = spare_name(docs)
    gone = near_groups(docs, percent).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name))
    return docs.join(gone.distinct(), F.col("doc_id").cast("long") == F.col(name), "left_anti")
