"""N-gram Jaccard join by a token-group matrix.

Every document is its set of distinct k-word shingles; equal sets are one node. Of two linked sets of n <= m tokens with a
similarity t the smaller has at least 2 t n / (1 + t) tokens in common with the larger, and the larger at least t m with
the smaller. A first pass takes the tokens that come first by hash: of n tokens n - ceil(t n) + l, of which linked sets share
l. Sets with fewer than l that occur in another set are linked with nothing.

The sets left are linked where they agree on two min-hashes, in bounded chunks by a product of their token matrix, which
makes most components. Then a set's tokens count only where another component has them, c of n. The slack c (1 + t) - 2 t n
of two linked sets is 0 or more in sum, so a token that only sets of too little slack have doesn't count either, and sets with
less than ceil(t n) go; this is done ``ROUNDS`` times. What is left is partitioned into groups of similar sets: by
the most common token of a set, then by min-hash, each of bounded size. The token-group matrix holds the groups of each token, and a group's
stored union all its tokens with the components that have them. The smaller set of a link asks: the groups of its rarest
tokens (c - 2 t n / (1 + t) + 1 of them, one of which linked sets share); the overlap with the stored union bounds
what any set of the group can share with it, and only groups that could reach t are opened and compared. All links
between components are found so, which makes the components exact; pairs within a component are not listed.

Words and shingles are compared by 64-bit hashes and sets by 128-bit digests of these; nodes carry 64 bits of theirs. Tokens
that very many sets have meet in aggregates and joins only, which combine or split them, never in one task.

Defined results: null and empty texts and those without words have the empty set, are linked with nothing and are their own
component; texts with fewer than k words have one shingle; repeated rows are linked (equal sets) and get rows of their own;
a null id counts as larger than any id and a component of null ids only is null; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veltra.llm._util import BYTE_HASH_LOWER, GOLDEN, arrow_rows, binary_parts, components, discard, materialize, mix64, read, release, shingle_hashes, slices, span_hashes, word_spans

#: Percent of a set's tokens that are taken beyond those that must be, to have l of them in common.
MORE = 10
#: Times that sets without enough tokens in other components are taken out of the matrix.
ROUNDS = 3
#: Most nodes of a chunk that is compared by a matrix product, most tokens of a chunk or group, and queries answered together.
CHUNK_NODES, CHUNK_TOKENS, QUERIES = 256, 1 << 20, 256
SEEDS = mix64(np.arange(4, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(7))


def sets(data: np.ndarray, offs: np.ndarray, k: int):
    """The sorted shingle hashes of each text."""
    for lo, hi in slices(offs):
        part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, stops, word_at = word_spans(part, at)
        words = span_hashes(part, starts, stops, BYTE_HASH_LOWER)
        for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist()):
            yield np.unique(shingle_hashes(words[a:b], k))


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def needed(n, percent: int):
    """Tokens that a set of n must share with another to reach the similarity, at least."""
    return -(-n * percent // 100)


def taken(n, percent: int):
    """How many of a set's tokens enter the matrix; n may be a number or a Column."""
    return n - needed(n, percent) + 1 + n * MORE // 100


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """A document's set size, digest, node and group keys."""

    def run(batches):
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for s in sets(*binary_parts(batch.column("text")), k):
                g = [0, 0]
                if len(s):
                    low = [int(mix64(s ^ seed).min()) for seed in SEEDS]
                    g = mix64(np.array([low[0], low[2]], np.uint64) * np.uint64(3) + np.array([low[1], low[3]], np.uint64)).astype(np.int64).tolist()
                d = digest(s)
                rows.append((len(s), d, node_of(d), *g))
            values = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *(pa.array(x, t) for x, t in zip(values, kinds))], names=["doc_id", "th", "n", "d", "node", "g0", "g1"])

    return docs.mapInArrow(run, "doc_id long, th long, n long, d binary, node long, g0 long, g1 long")


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, node): the tokens of each text's set that come first by hash."""

    def run(batches):
        for batch in batches:
            found = [s for s in sets(*binary_parts(batch.column("text")), k) if len(s)]
            parts = [s[: taken(len(s), percent)].view(np.int64) for s in found]
            node = np.repeat(np.array([node_of(digest(s)) for s in found], np.int64), [len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]))], names=["node", "token"])

    return docs.select("text").mapInArrow(run, "node long, token long")


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, s): the sets of the documents whose text hashes are wanted, computed again from their texts."""

    def run(batches):
        for batch in batches:
            found = [s for s in sets(*binary_parts(batch.column("text")), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(digest(s)) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "s"])

    texts = docs.select("doc_id", "th", "text").join(wanted, [F.col("th") == F.col("w_th"), F.col("doc_id").eqNullSafe(F.col("w_id"))], "left_semi")
    return texts.select("text").mapInArrow(run, "node long, s binary")


def _flat(found: DataFrame) -> DataFrame:
    """(token, node, grp) of the sets found (node, grp, s)."""

    def run(batches):
        for batch in batches:
            raw = [np.frombuffer(x, np.int64) for x in batch.column("s").to_pylist()]
            size = [len(x) for x in raw]
            columns = [np.concatenate([*raw, np.zeros(0, np.int64)]), *(np.repeat(batch.column(c).to_numpy(), size) for c in ("node", "grp"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["token", "node", "grp"])

    return found.select("node", "grp", "s").mapInArrow(run, "token long, node long, grp long")


def _unpack(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes and sets of a table, each node once."""
    nodes, where = np.unique(t.column("node").to_numpy(), return_index=True)
    raw = t.column("s").to_pylist()
    return nodes, [np.frombuffer(raw[i], np.uint64) for i in where]


def overlaps(group: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs by a product of the group's token matrix, some columns at a time."""
    flat = np.concatenate(group)
    row = np.repeat(np.arange(len(group)), [len(s) for s in group])
    by = np.argsort(flat, kind="stable")
    flat, row = flat[by], row[by]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, row = (np.cumsum(shared) - 1)[column[keep]], row[keep]
    out = np.zeros((len(group), len(group)), np.float32)
    step = 4096
    cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + step, step))
    for i in range(len(cut) - 1):
        m = np.zeros((len(group), step), np.float32)
        m[row[cut[i] : cut[i + 1]], column[cut[i] : cut[i + 1]] - i * step] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _link_chunk(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, group = _unpack(table)
        size = np.array([len(s) for s in group])
        both = overlaps(group)
        link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        label = np.arange(len(nodes))
        while True:  # smallest label among neighbours, until none changes
            least = np.where(link, label[None, :], len(nodes)).min(1)
            least = np.minimum(least, label)
            least = least[least]
            if (least == label).all():
                break
            label = least
        i = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.Table.from_arrays([pa.array(nodes[i]), pa.array(nodes[label[i]])], names=["a", "b"])

    return run


def _union(table: pa.Table) -> pa.Table:
    """A group's token union: its tokens in order, each with the smallest and the largest component that has it."""
    raw = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
    flat, grp = np.concatenate(raw), np.repeat(table.column("grp").to_numpy(), [len(x) for x in raw])
    by = np.lexsort((grp, flat))
    flat, grp = flat[by], grp[by]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    last = np.append(first[1:], True)
    arrays = [table.column("g")[:1], table.column("chunk")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in (flat[first], grp[first], grp[last]))]
    return pa.Table.from_arrays(arrays, names=["g", "chunk", "u", "lo", "hi"])


def covered(s: np.ndarray, own: int, union: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
    """How many tokens of s the group's union has from another component than own: none of its sets shares more."""
    at = np.minimum(np.searchsorted(union, s), len(union) - 1)
    return int(np.count_nonzero((union[at] == s) & ((lo[at] != own) | (hi[at] != own))))


def _bounded(percent: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        keep = []
        if len(left) and len(right):
            u, lo, hi = (np.frombuffer(right.column(c)[0].as_py(), t) for c, t in (("u", np.uint64), ("lo", np.int64), ("hi", np.int64)))
            for i, (own, raw) in enumerate(zip(left.column("grp").to_pylist(), left.column("s").to_pylist())):
                s = np.frombuffer(raw, np.uint64)
                if covered(s, own, u, lo, hi) * (100 + percent) >= 2 * percent * len(s):
                    keep.append(i)
        return left.select(["g", "chunk", "node"]).take(pa.array(keep, pa.int64()))

    return run


def _open_groups(percent: int):
    """Links of queries (node, grp, s) with the larger sets (node, grp, s) of a group, one for each pair of components."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            nodes, group = _unpack(right)
            grps = dict(zip(right.column("node").to_pylist(), right.column("grp").to_pylist()))
            grp = np.array([grps[x] for x in nodes.tolist()])
            size = np.array([len(s) for s in group])
            at = np.cumsum(size) - size
            tokens, column = np.unique(np.concatenate(group), return_inverse=True)
            by = np.argsort(column, kind="stable")
            member = np.repeat(np.arange(len(group)), size)[by]
            posting = np.searchsorted(column[by], np.arange(len(tokens) + 1))
            mark = np.zeros(len(tokens), bool)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            for q, own, raw in zip(left.column("node").to_pylist(), left.column("grp").to_pylist(), left.column("s").to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                n = len(s)
                where = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                where = where[tokens[where] == s]
                budget = len(where) - -(-2 * percent * n // (100 + percent))
                if budget < 0:
                    continue
                # The rarest tokens here, one of which each set linked with this one has.
                count = posting[where + 1] - posting[where]
                rare = where[np.argsort(count, kind="stable")[: budget + 1]]
                near = np.unique(np.concatenate([member[posting[x] : posting[x + 1]] for x in rare.tolist()]))
                near = near[(grp[near] != own) & ((size[near] > n) | ((size[near] == n) & (nodes[near] > q))) & (100 * n >= percent * size[near])]
                if not len(near):
                    continue
                mark[where] = True
                width = size[near]
                first = np.cumsum(width) - width
                both = np.add.reduceat(mark[column[np.arange(width.sum()) + np.repeat(at[near] - first, width)]].astype(np.int64), first)
                mark[where] = False
                for i in near[100 * both >= percent * (n + width - both)].tolist():
                    a, b = find(own), find(int(grp[i]))
                    if a != b:  # one link of two components is enough
                        out.append((q, int(nodes[i])))
                        root[max(a, b)] = min(a, b)
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _asked(pairs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries of pairs (node, g, chunk) with their sets, many of one group dealt over parts, and the parts of each group."""
    opened = pairs.groupBy("g", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    left = pairs.join(opened, ["g", "chunk"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).join(found, "node")
    parts = opened.select("g", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    columns = ["g", "chunk", "part", "node", "grp", "s"]
    return left.select(*columns).toDF(*columns), parts  # new attributes, as the other side of the cogroup has the same tables


def _chunks(rows: DataFrame, keys: list[str], nodes: int | None, salt: int) -> DataFrame:
    """rows (keys, node, n) with chunk: as many per key as its nodes and tokens need; keys of one node go if nodes bounds a chunk."""
    count = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_t"))
    parts = F.ceil(F.col("_t") / CHUNK_TOKENS)
    if nodes:
        count, parts = count.where("_c > 1"), F.greatest(F.ceil(F.col("_c") / nodes), parts)
    return rows.join(count, keys).withColumn("chunk", F.pmod(F.xxhash64(F.lit(salt), "node"), parts).cast("int")).drop("_c", "_t")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, th, first) of each row: documents link when their sets' Jaccard similarity is
    percent / 100 or more. th is xxhash64 of the text; first marks the rows of a component's smallest (doc_id, th), null ids last, and all rows without words."""
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    rows = materialize(_profile(docs, k), "profile")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    classes = rows.where("n > 0").groupBy("d").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "node", "g0", "g1")])
    classes = materialize(classes, "classes")

    # Sets of which at least l prefix tokens occur in another set; copies of a set bring its tokens as often as there are copies.
    shared = _prefixes(docs, k, percent).groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    shared = materialize(shared, "shared")
    release(spark)
    count = _prefixes(docs, k, percent).join(shared, "token", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    l = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) * MORE / 100)  # noqa: E741
    near = materialize(count.join(classes, "node").where(F.col("c") >= l * F.col("copies")).select("node", "n", "g0", "g1", F.col("first.doc_id").alias("w_id"), F.col("first.th").alias("w_th")), "near")
    discard(shared)
    release(spark)
    found = _sets_of(docs, near.select("w_id", "w_th"), k).dropDuplicates(["node"])
    found = materialize(found.join(near.drop("w_id", "w_th"), "node"), "sets")
    discard(near)
    release(spark)

    # Links of sets that agree on two min-hashes; the second pair of hashes has other chunks, so that parts of a large family meet.
    chunked = [_chunks(found.select(F.lit(r).alias("r"), F.col(f"g{r}").alias("g"), "node", "n"), ["r", "g"], CHUNK_NODES, r + 1) for r in (0, 1)]
    chunked = chunked[0].unionByName(chunked[1]).join(found.select("node", "s"), "node").select("r", "g", "chunk", "node", "s")
    links = materialize(chunked.groupBy("r", "g", "chunk").applyInArrow(_link_chunk(percent), "a long, b long"), "links")
    group = components(links).select(F.col("id").alias("node"), F.col("component").alias("grp"))
    before, found = found, materialize(found.join(group, "node", "left").withColumn("grp", F.coalesce("grp", "node")), "grouped")
    discard(before, links)
    release(spark)

    must, slack = F.ceil(F.col("n") * percent / 100), F.col("c") * (100 + percent) - F.col("n") * 2 * percent
    by_node = Window.partitionBy("node")  # at most a document's set

    def between(tokens: DataFrame) -> DataFrame:
        """The tokens that another component has in sets of enough slack, counted; sets with too few of them go."""
        other = tokens.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max(slack).alias("best"), F.count(F.lit(1)).alias("df")).where("lo <> hi")
        other = materialize(other, "other")  # written first: Spark splits a join's frequent keys only where both sides come straight from a shuffle
        return tokens.join(other, "token").where(slack + F.col("best") >= 0).withColumn("c", F.count(F.lit(1)).over(by_node)).where(F.col("c") >= must)

    # At first every slack is above 0: only whether another component has a token counts, and rows are as narrow as can be.
    flat, nodes = _flat(found), found.select("node", "n", "grp")
    other = materialize(flat.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token"), "other")
    release(spark)
    tokens = flat.select("token", "node").join(other, "token", "left_semi").withColumn("c", F.count(F.lit(1)).over(by_node))
    tokens = materialize(tokens.join(nodes, "node").where(F.col("c") >= must).select("token", "node", "n", "grp", "c"), "matrix0")
    release(spark)
    for step in range(1, ROUNDS):
        before, tokens = tokens, materialize(between(tokens).select("token", "node", "n", "grp", "c"), f"matrix{step}")
        discard(before)
        release(spark)
    # Of the c tokens that a set has in common with others the c - ceil(t n) + 1 rarest, and its most common one.
    asking = between(tokens).withColumn("g", F.max(F.struct("df", "token")).over(by_node)["token"]).withColumn("nth", F.row_number().over(by_node.orderBy("df", "token")))
    asking = materialize(asking.where(F.col("nth") <= F.col("c") - must + 1).select("token", "node", "n", "grp", "c", "g", "nth"), "asking")
    discard(tokens)
    release(spark)
    # Groups of similar sets, linked or not: one common token, then one min-hash, then what fits.
    members = asking.where("nth = 1").select("g", "node", "n", "grp").join(found.select("node", "g0"), "node")
    parts = members.groupBy("g").agg(F.ceil(F.sum("n") / CHUNK_TOKENS).alias("parts"))
    members = members.join(parts, "g").select(F.xxhash64("g", F.pmod("g0", "parts")).alias("g"), "node", "n", "grp")
    members = materialize(_chunks(members, ["g"], None, 0), "members")
    held = asking.drop("g").join(members.select("node", "g", "chunk"), "node")
    matrix = held.groupBy("token", "g", "chunk").agg(
        F.min("n").alias("least"), F.max(F.struct("n", "node")).alias("last"), F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max(slack).alias("best")
    )
    matrix = materialize(matrix, "groups")
    fits = ((F.col("lo") != F.col("grp")) | (F.col("hi") != F.col("grp"))) & (F.struct("n", "node") < F.col("last")) & (F.col("n") * 100 >= F.col("least") * percent) & (slack + F.col("best") >= 0)
    asks = asking.where((F.col("nth") - 1) * (100 + percent) <= slack).drop("g")
    pairs = materialize(asks.join(matrix, "token").where(fits).select("node", "g", "chunk").distinct(), "pairs")
    release(spark)
    labels = found.select("node", F.col("grp").alias("c"))
    if not pairs.isEmpty():
        known = found.select("node", "grp", "s")
        inside = members.select("g", "chunk", "node")
        unions = inside.join(pairs.select("g", "chunk").distinct(), ["g", "chunk"], "left_semi").join(known, "node").groupBy("g", "chunk").applyInArrow(_union, "g long, chunk int, u binary, lo binary, hi binary")
        left, parts = _asked(pairs, known)
        right = parts.join(materialize(unions, "unions"), ["g", "chunk"])
        pairs = materialize(left.groupBy("g", "chunk", "part").cogroup(right.groupBy("g", "chunk", "part")).applyInArrow(_bounded(percent), "g long, chunk int, node long"), "bounded")
        left, parts = _asked(pairs, known)
        right = parts.join(inside, ["g", "chunk"]).join(known, "node").select("g", "chunk", "part", "node", "grp", "s")
        opened = left.groupBy("g", "chunk", "part").cogroup(right.groupBy("g", "chunk", "part")).applyInArrow(_open_groups(percent), "a long, b long")
        opened = opened.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        final = components(opened)
        labels = labels.join(final.withColumnRenamed("id", "c"), "c", "left").select("node", F.coalesce("component", "c").alias("c"))
        release(spark)
    labelled = classes.select("d", "node", "first").join(labels, "node", "left").withColumn("c", F.coalesce("c", "node"))
    least = labelled.groupBy("c").agg(F.min("first").alias("first"))
    named = materialize(labelled.drop("first").join(least, "c").select(F.col("d").alias("_d"), "first"), "named")
    out = rows.join(named, F.col("d") == F.col("_d"), "left")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "th", F.when(F.col("n") > 0, own).otherwise(True).alias("first"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
