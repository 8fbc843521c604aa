"""Operator 6: n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Sets of similar size share instances; in an instance with sizes
up to R, similar sets differ in at most k elements. The domain of shingles is partitioned, and a set's signatures are
its projections onto parts or unions of parts:

* First level: more than k parts. Two sets that differ in k elements agree in one of any k + 1 parts. A set emits, in a
  fixed order, parts with at least two of its elements until it has k + 1 (k for its own size); the shorter of two
  such lists already holds an agreeing part. An empty part, which all sets share, is never emitted.
* Second level, for sets with too few such parts only (two sets that both have too few find each other here): the
  domain falls into more than k / 2 groups of three parts. In one of any k / 2 + 1 groups the sets differ in one element
  at most, so they agree on the union of two of its parts. A signature then covers several elements again.

Signatures that occur once are found by a Golomb-coded exchange and dropped. Equal sets collapse to one node. Groups of
nodes that share a signature join into clusters, named by the best connected member; near copies share many signatures
and fall into one. A cluster of bounded size is resolved in one task. A larger one is resolved by stars: all members
are compared with its best connected one, c. Members of c's component need no further comparison with each other. For
any other member x only *additions*, elements that c lacks, can tell: what x shares with any partner beyond c's elements
must be at least ``t`` additions, so both list the first of their additions in hash order (a prefix filter) and meet
in a cluster of such an element. Where no addition needs to be shared (x is nearly a part of c), the sizes of the sets
and of their intersections with c tell which members can be partners at all, and these form a cluster of their own. The
new clusters are treated alike, less the pairs that are in one component already. So no link between different sets is
lost, no pair of a group is ever a row, and unrelated members of a group cost one comparison each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, discard, free_names, keyed_documents, lower_ascii, settled, shuffle_partitions, sized_join
from .components import connected
from .exchange import key_bits, key_levels, keyed_pass, repeated_keys
from .hashing import _BASE, U, Words, mix

#: Sizes of an instance span this ratio.
RATIO = 2.0
#: Members, and elements of all their sets, up to which a cluster is resolved in one task.
CLUSTER_NODES, CLUSTER_ELEMENTS = 1000, 1_000_000
#: Rounds of stars; what is still larger then (sets that are random parts of one another) goes to tasks by pairs of blocks.
ROUNDS = 6
#: Elements that a task of small clusters takes in at a time, about.
TASK_ELEMENTS = 2_000_000
#: Elements that a pass over the small clusters sends at least, and passes at most.
PASS_ELEMENTS, PASSES = 16_000_000, 32


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles, sorted by text and hash, and how many each text has."""
    words = Words([lower_ascii(t) for t in texts])
    h = words.hash
    count = len(h) - n + 1
    total = np.zeros(max(0, count), U)
    for j in range(n):
        total = total * U(_BASE) + h[j : j + len(total)]
    ok = words.text[: len(total)] == words.text[n - 1 :][: len(total)]
    keys, text = mix(total[ok]), words.text[: len(total)][ok]
    # fewer words than a shingle: the whole sequence
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    whole = np.zeros(len(short), U)
    for j in range(n - 1):
        has = words.counts[short] > j
        at = np.minimum(words.first[short] + j, max(0, len(h) - 1))
        whole = np.where(has, whole * U(_BASE) + (h[at] if len(h) else U(0)), whole)
    keys, text = np.concatenate((keys, mix(whole + U(0x51ED27)))), np.concatenate((text, short))
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[fresh], text[fresh]
    return keys, text, np.bincount(text, minlength=len(texts))


def instances(most: int, share: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, k, parts): every pair with Jaccard of ``share`` percent lies in one of them."""
    out, low = [], 1
    while True:
        high = max(low, int(low * RATIO))
        k = (100 - share) * 2 * high // (100 + share)
        out.append((low, high, k, 1 if k == 0 else max(k + 1, -(-11 * (k + 1) // 10))))
        if high >= most:
            return out
        low = -(-share * (high + 1) // 100)


def signatures(keys: np.ndarray, text: np.ndarray, sizes: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of all sets of a block."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first = np.concatenate(([0], np.cumsum(sizes)))
    for number, (low, high, k, parts) in enumerate(instances(int(sizes.max()) if len(sizes) else 0, share)):
        mine = np.flatnonzero((sizes >= low) & (sizes <= high))
        step = max(1, 2_000_000 // parts)
        for a in range(0, len(mine), step):  # bounds the table of parts
            docs = mine[a : a + step]
            s = sizes[docs]
            row = np.repeat(np.arange(len(docs)), s)
            element = keys[np.arange(int(s.sum())) + np.repeat(first[docs] - np.concatenate(([0], np.cumsum(s)))[:-1], s)]
            # how much a partner of at most this similarity can differ: it has up to size / share elements
            differ = (100 - share) * (s + np.minimum(s * 100 // share, high)) // (100 + share)
            count, content = _projected(element, row, len(docs), parts, 2 * number + 1)
            strong = count > (1 if k else 0)
            r, p = np.nonzero(strong & (np.cumsum(strong, axis=1) <= differ[:, None] + 1))
            found.append((_named(content[r, p], count[r, p], p, 2 * number), docs[r]))
            poor = strong.sum(axis=1) <= differ
            if poor.any():
                sig, r = _unions(element[poor[row]], (np.cumsum(poor) - 1)[row[poor[row]]], differ[poor], k, number)
                found.append((sig, docs[poor][r]))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sig, doc = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(doc, kind="stable")
    return sig[order], doc[order]


def _projected(element: np.ndarray, row: np.ndarray, rows: int, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of elements, sum of their hashes) of each row in each part."""
    scattered = mix(element + U(salt))
    cell = row * parts + (((scattered >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
    content = np.zeros(rows * parts, U)
    np.add.at(content, cell, mix(scattered))
    return np.bincount(cell, minlength=len(content)).reshape(rows, parts), content.reshape(rows, parts)


def _named(content: np.ndarray, count: np.ndarray, part: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(content + count.astype(U)) + part.astype(U) * U(1 << 20) + U(salt))


def _unions(element: np.ndarray, row: np.ndarray, differ: np.ndarray, k: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the second level: two of three parts in each group.

    A set without enough groups whose three unions all have an element emits what it has, the empty ones too.
    """
    needed = k // 2 + 1
    groups = needed if needed <= 3 else -(-23 * needed // 20)
    rows = len(differ)
    count, content = (x.reshape(rows, groups, 3) for x in _projected(element, row, rows, 3 * groups, (1 << 40) + number))
    count, content = count.sum(axis=2, keepdims=True) - count, content.sum(axis=2, keepdims=True, dtype=U) - content
    strong = (count > 0).all(axis=2)
    before = np.cumsum(strong, axis=1) - strong
    need = differ // 2 + 1
    emit = (count > 0) & (before < need[:, None])[:, :, None]
    emit |= (strong.sum(axis=1) < need)[:, None, None]
    r, g, j = np.nonzero(emit)
    return _named(content[r, g, j], count[r, g, j], 3 * g + j, 2 * number + 1), r


def similar_components(spark: SparkSession, docs: DataFrame, n: int = 4, share: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents link when the Jaccard similarity of their sets of ``n``-word shingles is at least ``share`` percent
    (A-Z lower-cased; a shorter text is one shingle). A component's id is the least doc_id reachable by links. Null,
    empty and blank texts have no shingle and link with nothing. Rows that repeat a document link with each other;
    null ids count as larger than all others. An empty table gives no rows. Sets are held as 64-bit hashes.
    """
    placed = _placed(spark, docs, n, share, id_col, text_col)
    least = settled(spark, placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return sized_join(placed, least, ["root"], "left").select("doc_id", "n_shingles", own.alias("component_id"))


def _placed(spark: SparkSession, docs: DataFrame, n: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, rid, fp, n_shingles, node, root`` of each document; rows with shingles and the same root are a component."""
    keyed = keyed_documents(docs, id_col, text_col)

    def keys_of(texts: list[bytes], _batch: pa.RecordBatch) -> tuple[dict, np.ndarray, np.ndarray]:
        keys, text, sizes = shingles(texts, n)
        whole = np.zeros(len(texts), U)
        np.add.at(whole, text, mix(keys))
        sig, doc = signatures(keys, text, sizes, share)
        # copies within the block need not tell the owners again
        return {"n_shingles": pa.array(sizes.astype(np.int64)), "node": pa.array(mix(whole + sizes.astype(U)).view(np.int64))}, sig, np.bincount(doc, minlength=len(texts))

    kept = key_bits(docs.count())
    table = keyed_pass(spark, keyed, keys_of, "n_shingles long, node long", "signatures", key_bits=kept)
    rows = settled(spark, table.where("owner < 0").select("doc_id", "rid", "fp", "n_shingles", "node"), "rows")
    named = repeated_keys(table, carry=("n_shingles", "node"), key_bits=kept)
    nodes = settled(spark, named.groupBy("node").agg(F.min(F.struct("rid", "fp")).alias("at"), F.first("n_shingles").alias("size"), F.first("payload").alias("payload")), "nodes")
    discard(spark, table)
    members = _candidates(spark, nodes)
    label = settled(spark, members.select("node").distinct().withColumn("root", F.col("node")), "labels")
    if label.limit(1).count():
        used = settled(spark, nodes.join(label.select("node"), "node", "left_semi").select("node", "at.rid", "at.fp"), "used")

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in blocks(batches):
                keys, _, sizes = shingles(texts, n)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_pydict({"node": batch.column(batch.schema.get_field_index("node")), "payload": pa.array([keys[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)], pa.binary())})

        sets = sized_join(keyed, used, ["rid", "fp"], "inner").select("node", "text").mapInArrow(sets_of, "node long, payload binary").groupBy("node").agg(F.first("payload").alias("payload"))
        sets = settled(spark, sets, "sets")
        discard(spark, nodes)
        label = _resolve(spark, members, label, sets, share)
        discard(spark, sets)
    return rows.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 4, share: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they are, and every row without shingles.

    It is the row with the least id (null ids last) and, where rows share that, the least hash of the text; of rows
    that repeat it whole any one.
    """
    key = ["none", "rid", "fp"]
    placed = _placed(spark, docs, n, share, id_col, text_col).where("n_shingles > 0").withColumn("none", F.col("doc_id").isNull())
    keeper = placed.groupBy("root").agg(F.min(F.struct(*key)).alias("keeper"), F.count("*").alias("rows")).where("rows > 1")
    keeper = settled(spark, keeper.select("root", "keeper"), "keepers")
    verdict = sized_join(placed, keeper, ["root"], "inner").groupBy(*key).agg(F.first(F.struct(*key) == F.col("keeper")).alias("keeps"), F.count("*").alias("rows"))
    none, rid, fp = names = free_names(docs, *(f"__{c}" for c in key))
    verdict = settled(spark, verdict.where("not keeps or rows > 1").select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)), "keeps"), "near_copies")
    keyed = docs.withColumns({none: F.col(id_col).isNull(), rid: F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), fp: F.xxhash64(text_col)})
    again = verdict.where("keeps").select(*names)
    left = sized_join(keyed, verdict.select(*names), names, "left_anti")
    # rows repeated whole are the exception, and only they are compared by their text
    if again.limit(1).count():
        left = left.unionByName(sized_join(keyed, again, names, "left_semi").dropDuplicates([*names, text_col]))
    return left.drop(*names)


def _candidates(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """``cluster, node, size, degree``: nodes that share a signature with others; degree counts a node's fellows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = [np.unique(np.frombuffer(x, np.int64)) for x in batch.column(2).to_pylist()]
            many = np.fromiter(map(len, lists), np.int64, len(lists))
            yield pa.RecordBatch.from_pydict({"sig": np.concatenate(lists), "node": np.repeat(node, many), "size": np.repeat(size, many)})

    return _clustered(spark, nodes.select("node", "size", "payload").mapInArrow(explode, "sig long, node long, size long"))


def _clustered(spark: SparkSession, flat: DataFrame) -> DataFrame:
    """``cluster, node, size, degree`` of ``sig, node, size``: groups of nodes with the same ``sig`` joined into clusters."""
    every = settled(spark, flat, "members")
    groups = every.groupBy("sig").agg(F.count("*").alias("fellows")).where("fellows > 1")
    flat = every.join(groups, "sig")
    degree = flat.groupBy("node").agg(F.sum("fellows").alias("degree"))
    flat = settled(spark, flat.drop("fellows").join(degree, "node"), "members")
    discard(spark, every)
    # a group's cluster is its best connected member; all pairs of the group are pairs of the cluster
    top = flat.groupBy("sig").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("top")).select("sig", (-F.col("top.node")).alias("cluster"))
    clusters = settled(spark, flat.join(top, "sig").select("cluster", "node", "size", "degree").distinct(), "clusters")
    discard(spark, flat)
    return clusters


def _components(held: list[np.ndarray], node: np.ndarray, root: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links that connect the components of a few sets, the first of which are the best connected."""
    size = np.fromiter(map(len, held), np.int64, len(held))
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    _, ids = np.unique(np.concatenate(held), return_inverse=True)
    _, label = np.unique(root, return_inverse=True)
    mark, links = np.zeros(int(ids.max()) + 1, bool), []
    for i in range(len(node)):
        other = label != label[i]
        if not other.any():
            continue
        own = ids[begin[i] : begin[i] + size[i]]
        mark[own] = True
        common = np.add.reduceat(mark[ids].astype(np.int32), begin)
        mark[own] = False
        for j in np.flatnonzero(other & (100 * common >= share * (size + size[i] - common))):
            if label[j] != label[i]:
                links.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return links


def _within(spark: SparkSession, clusters: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that connect the components of each small cluster: fewer than it has nodes.

    ``clusters``: cluster, node, size, degree, root. A task takes whole clusters, as many as it has room for. A set
    travels once for each of its clusters; passes over some of the clusters each send about as much as all sets hold,
    so that what lies on disk at a time does not grow with the number of clusters of a set.
    """
    clusters = settled(spark, clusters.select("cluster", "node", "size", "degree", "root"), "small")
    total = clusters.agg(F.sum("size")).first()[0] or 0
    once = clusters.select("node", "size").distinct().agg(F.sum("size")).first()[0] or 0
    passes = max(1, min(PASSES, -(-total // max(once, PASS_ELEMENTS))))
    tasks = max(4 * shuffle_partitions(spark), -(-total // (TASK_ELEMENTS * passes)))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster", "degree", "node"], ascending=[True, False, True], ignore_index=True)
        cluster, node, root, payload = (pdf[c].to_numpy() for c in ("cluster", "node", "root", "payload"))
        cut = np.flatnonzero(np.diff(cluster)) + 1
        links = []
        for a, b in zip([0, *cut], [*cut, len(pdf)], strict=True):
            links += _components([np.frombuffer(x, U) for x in payload[a:b]], node[a:b], root[a:b], share)
        return pd.DataFrame({"a": pd.Series([x for x, _ in links], dtype="int64"), "b": pd.Series([x for _, x in links], dtype="int64")})

    task = F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task")
    found = []
    for number in range(passes):
        some = clusters.where(F.pmod(F.xxhash64("cluster", F.lit("pass")), F.lit(passes)) == number)
        sent = sized_join(sets, some, ["node"], "inner").select("cluster", "node", "degree", "root", "payload", task)
        found.append(settled(spark, sent.groupBy("task").applyInPandas(resolve, "a long, b long"), "links"))
    return functools.reduce(DataFrame.unionByName, found)


def _resolve(spark: SparkSession, members: DataFrame, label: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``node, root``: components of the similar nodes. Small clusters in tasks, larger ones by stars."""
    levels = None
    for number in range(ROUNDS + 1):
        placed = members.join(label, "node")
        spread = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("elements"), F.min("root").alias("one"), F.max("root").alias("other"))
        small = (F.col("n") <= CLUSTER_NODES) & (F.col("elements") <= CLUSTER_ELEMENTS)
        spread = settled(spark, spread.where("one <> other").select("cluster", "n", small.alias("small")), "cluster_sizes")
        label = _joined(spark, label, _within(spark, placed.join(spread.where("small"), "cluster", "left_semi"), sets, share))
        large = spread.where("not small").drop("small")
        if not large.limit(1).count():
            break
        placed = settled(spark, members.join(large, "cluster").join(label, "node"), "large")
        if number == ROUNDS:
            label = _joined(spark, label, _within(spark, _blocks(placed), sets, share))
            break
        levels = levels or _levels(spark, sets, settled(spark, placed.select("node").distinct(), "starred_nodes"))
        members, label = _star(spark, placed.drop("n"), label, sets, levels, share)
    return label


def _blocks(placed: DataFrame) -> DataFrame:
    """Clusters for all pairs of blocks of a cluster, each of them small."""
    half = CLUSTER_NODES // 2 or 1
    count = F.ceil(F.col("n") / half).cast("long")
    cut = placed.withColumn("block", F.pmod(F.xxhash64("node"), count)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return cut.withColumn("cluster", F.xxhash64("cluster", F.least("block", "with"), F.greatest("block", "with"))).select("cluster", "node", "size", "degree", "root")


def _levels(spark: SparkSession, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, levels``: how often each element of a node's set occurs in the sets of all ``nodes``, as key_levels has it."""

    def elements(payloads: list[bytes], _batch: pa.RecordBatch) -> tuple[dict, np.ndarray, np.ndarray]:
        return {}, np.frombuffer(b"".join(payloads), U), np.fromiter((len(x) // 8 for x in payloads), np.int64, len(payloads))

    none = F.lit(None).cast("long")
    some = sized_join(sets, nodes, ["node"], "left_semi")
    table = keyed_pass(spark, some.select(F.col("node").alias("doc_id"), none.alias("rid"), none.alias("fp"), F.col("payload").alias("text")), elements, "", "elements")
    levels = settled(spark, key_levels(table).withColumnRenamed("doc_id", "node"), "levels")
    discard(spark, table)
    return levels


def _star(spark: SparkSession, placed: DataFrame, label: DataFrame, sets: DataFrame, levels: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """One round for large clusters: (the clusters that are left to do, labels with the stars' links)."""
    best = placed.groupBy("cluster").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("best"))
    best = settled(spark, best.select("cluster", (-F.col("best.minus")).alias("center")), "best")
    centers = settled(spark, sized_join(sets.select(F.col("node").alias("center"), F.col("payload").alias("centre_set")), best, ["center"], "inner"), "centers")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, linked, lists = [], [], []
            for x, often, c in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("payload", "levels", "centre_set")), strict=True):
                x, often, c = np.frombuffer(x, U), np.frombuffer(often, np.uint8), np.frombuffer(c, U)
                new = ~np.isin(x, c, assume_unique=True)
                added, often = x[new], often[new]
                p = len(x) - len(added)
                common.append(p)
                linked.append(100 * p >= share * (len(x) + len(c) - p))
                # additions that must be shared, beyond all that a partner can share of c
                least = -(-share * len(x) // 100) - p
                first = np.argsort(often, kind="stable")[: len(added) - max(least, 1) + 1]
                lists.append(added[first[often[first] > 1]].tobytes())
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(kept)} | {"common": pa.array(common, pa.int64()), "linked": pa.array(linked, pa.bool_()), "added": pa.array(lists, pa.binary())})

    kept = ("cluster", "node", "size", "degree", "center")
    members = sized_join(sets, placed.select("cluster", "node", "size", "degree"), ["node"], "inner")
    members = sized_join(members, levels, ["node"], "inner", "levels")
    starred = sized_join(members, centers, ["cluster"], "inner", "centre_set").select(*kept, "payload", "levels", "centre_set")
    starred = starred.mapInArrow(compare, "cluster long, node long, size long, degree long, center long, common long, linked boolean, added binary")
    starred = settled(spark, starred.where("node <> center"), "starred")
    label = _joined(spark, label, settled(spark, starred.where("linked").select(F.col("center").alias("a"), F.col("node").alias("b")), "links"))
    at_center = label.select(F.col("node").alias("center"), F.col("root").alias("main"))
    inner = settled(spark, centers.select("center").distinct().join(at_center, "center"), "main_roots")
    starred = sized_join(starred.drop("linked").join(label, "node"), inner, ["center"], "inner").withColumn("outer", F.col("root") != F.col("main"))
    starred = settled(spark, starred.drop("center", "main"), "starred")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}
            lists = [np.frombuffer(x, U) for x in col["added"]]
            many = np.fromiter(map(len, lists), np.int64, len(lists))
            sig = mix(mix(np.repeat(col["cluster"].view(U), many)) + np.concatenate([np.zeros(0, U), *lists])).view(np.int64)
            yield pa.RecordBatch.from_pydict({"sig": sig} | {c: np.repeat(col[c], many) for c in row})

    row = ("node", "size", "root")
    flat = settled(spark, starred.select("cluster", *row, "added").mapInArrow(explode, ", ".join(f"{c} long" for c in ("sig", *row))), "additions")
    met = flat.groupBy("sig").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other")
    left = _clustered(spark, flat.join(met.select("sig"), "sig", "left_semi").select("sig", "node", "size"))
    # pairs that need not share an addition: both have much of c, and little else
    outer = F.col("outer")
    starred = settled(spark, _can_meet(starred, outer, F.lit(True), share, "able").where("able or not outer"), "able")
    partner = _can_meet(starred, F.lit(True), F.col("able"), share, "partner").where("partner or able")
    left = left.unionByName(partner.withColumn("cluster", F.xxhash64("cluster", F.lit("parts"))).select("cluster", "node", "size", "degree"))
    return settled(spark, left, "members"), label


def _can_meet(starred: DataFrame, which: F.Column, others: F.Column, share: int, name: str) -> DataFrame:
    """``starred`` with a flag for members (``which``) that could link with one of ``others`` by elements of c alone.

    x and y share at most the smaller of their intersections with c; that must reach the share of their union.
    """
    reach = (100 + share) * F.col("common")
    # at most one row for each number of elements of c
    levels = starred.where(others).groupBy("cluster", "common").agg(F.min("size").alias("least"))
    every = starred.select("cluster", "common").distinct().join(levels, ["cluster", "common"], "left")
    by = Window.partitionBy("cluster").orderBy("common")
    above = F.min("least").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    below = F.max(reach - share * F.col("least")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    every = every.select("cluster", "common", above.alias("above"), below.alias("below"))
    can = (reach >= share * (F.col("size") + F.col("above"))) | (F.col("below") >= share * F.col("size"))
    return starred.join(every, ["cluster", "common"]).withColumn(name, which & F.coalesce(can, F.lit(False))).drop("above", "below")


def _joined(spark: SparkSession, label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components that ``links`` connect are one."""
    if not links.limit(1).count():
        return label
    ends = links.join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    roots = connected(spark, ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = label.join(roots.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
    return settled(spark, moved.select("node", F.coalesce("new", "root").alias("root")), "labels")
