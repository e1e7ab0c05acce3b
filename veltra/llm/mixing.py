"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
``max_repeat`` times its source and the excess is shared again by weight. Each source is cut into blocks by a hash
of its documents; a copy of a block is a ticket. A source's exact quota of tickets is split down a binary tree: at
each node the number of tickets of every source that go left is drawn from the multivariate hypergeometric
distribution (one univariate draw per source, given those before). A shard then draws its quota from the source's
permuted tickets, disjoint from the other shards', and shuffles its rows by hash. The block that holds the end of a source's
target is taken in part: by smaller blocks if it is large, then row by row. Texts move once, to their shard; what a row
needs to know for that is in tables with a row per source and block. DataFrame and SQL functions only.

Defined results: a null text has size 0; null sources are one source; a size-0 source has target 0 and takes 0; rows that
repeat id, source and text are placed alike; equal ids with other texts are rows of their own; null ids are told apart by
their texts; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, log2, pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veltra.llm._util import materialize, read, release

WORD = r"[^\x20\x09-\x0D]+"
#: Words a block holds about, and the most blocks a source is cut into; larger blocks are cut again where they are taken in part.
BLOCK_WORDS, MOST_BLOCKS = 50_000, 4096
#: Rows of the tables of sources and blocks up to which they are sent to all executors; beyond, they are joined by shuffles.
SMALL = 1 << 17
#: Least number of output shards, and words of a shard from which there are more of them.
SHARDS, SHARD_WORDS = 16, 20_000_000


def _ln_factorial(n: str) -> str:
    return f"(case when {n} < 2 then 0D when {n} <= 20 then ln(cast(factorial(cast({n} as int)) as double)) else ({n} + 0.5D) * ln({n}) - {n} + {0.5 * log(2 * pi)!r}D + 1D / (12D * {n}) - 1D / (360D * {n} * {n} * {n}) end)"


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"


def _draw(all_: str, marked: str, drawn: str, u: str) -> str:
    """Inverse of the hypergeometric distribution at u: of all_ tickets marked are of one kind and drawn are taken. The
    sum runs over 12 standard deviations around the mean, outside of which lies less than 1e-20."""
    n, k, m = (f"cast({x} as double)" for x in (all_, marked, drawn))
    mean = f"({m} * {k} / greatest({n}, 1D))"
    sd = f"sqrt(greatest(0D, {mean} * ({n} - {k}) / greatest({n}, 1D) * ({n} - {m}) / greatest({n} - 1D, 1D)))"
    low = f"greatest(0L, {drawn} - ({all_} - {marked}), cast(floor({mean} - 12D * {sd}) as bigint) - 1L)"
    high = f"least({drawn}, {marked}, cast(ceil({mean} + 12D * {sd}) as bigint) + 1L)"
    p = f"exp({_ln_choose(k, 'x')} + {_ln_choose(f'({n} - {k})', f'({m} - x)')} - {_ln_choose(n, m)})"
    return f"aggregate(transform(sequence({low}, {high}), z -> cast(z as double)), named_struct('sum', 0D, 'at', cast({low} as double)), (a, x) -> if(a.sum < {u}, named_struct('sum', a.sum + {p}, 'at', x), a), a -> cast(a.at as bigint))"


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (k, q): tickets of each source. Returns (k, bounds): cumulated tickets at the end of each shard. shards: a power of 2."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("quota")).select(F.lit(0).alias("node"), "quota")
    for level in range(int(log2(shards))):
        total = F.aggregate("quota", F.lit(0).cast("bigint"), lambda a, x: a + x.q)
        node = node.withColumn("total", total).withColumn("half", F.expr("total div 2"))
        u = f"((pmod(xxhash64({seed}, {level}, node, e.k), 4503599627370496L) + 0.5D) / 4503599627370496D)"
        step = f"named_struct('n', s.n - e.q, 'm', s.m - g, 'out', concat(s.out, array(named_struct('k', e.k, 'q', g))))"
        one = f"transform(array({_draw('s.n', 'e.q', 's.m', u)}), g -> {step})[0]"
        left = F.expr(f"aggregate(quota, named_struct('n', total, 'm', half, 'out', cast(array() as array<struct<k: int, q: bigint>>)), (s, e) -> {one}, s -> s.out)")
        node = materialize(node.withColumn("left", left), f"node{level}")
        right = F.transform("quota", lambda x, i: F.struct(x.k.alias("k"), (x.q - F.col("left")[i].q).alias("q")))
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quota")))).alias("c")).select("c.node", "c.quota")
    rows = node.select("node", F.inline("quota"))
    bounds = rows.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "q"))), lambda x: x.q).alias("qs"))
    return bounds.select("k", F.expr("transform(qs, (x, i) -> aggregate(slice(qs, 1, i + 1), 0L, (a, y) -> a + y))").alias("bounds"))


def targets(sizes: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, k, target). One row per source goes through one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("k", F.row_number().over(order)).withColumn("w", ((F.col("k") - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weight", F.sum("w").over(every))
    c, w = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("full", F.col("cap") / F.col("w") < (F.col("total") - c) / (F.col("weight") - w))
    done, dw = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    level = (F.col("total") - done) / F.greatest(F.col("weight") - dw, F.lit(1.0))
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(level * F.col("w"), F.col("cap")))).select("source", "source_size", "k", "target")


@dataclass(frozen=True)
class Plan:
    """sizes (doc_id, source, size, h) of every row; goal, a row per source; blocks (k, b, left, words, placements) that are
    drawn; ends (h, placements) of rows in blocks that are taken in part."""

    sizes: DataFrame
    goal: DataFrame
    blocks: DataFrame
    ends: DataFrame
    seed: int


def _unit(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, source, F.xxhash64(text))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL else table


def _with_placements(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (source, h and others) with source_size, target and placements, null where none of the row's block is drawn."""
    rows = rows.withColumnRenamed("source", "src").join(_small(plan.goal), F.col("src").eqNullSafe(F.col("source"))).drop("src")
    rows = rows.withColumn("b", F.pmod("h", "n_blocks").cast("int")).join(_small(plan.blocks), ["k", "b"], "left")
    part = F.coalesce((F.col("left") > 0) & (F.col("left") < F.col("words")), F.lit(False))
    whole, ends = rows.where(~part), rows.where(part).drop("placements").join(plan.ends, "h", "left")
    drop = ["k", "b", "n_blocks", "copies", "rest", "left", "words"]
    return whole.drop(*drop).unionByName(ends.drop(*drop))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, block_words: int = BLOCK_WORDS, max_repeat: float = 3.0, seed: int = 17) -> Plan:
    """What is drawn of every source, block and row, and for which shard."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _unit(F.col(id_col), F.col(source_col), F.col(text_col), seed).alias("h"))
    rows = materialize(rows, "sizes")
    if shards is None:  # a power of 2 that grows with the words
        words = rows.agg(F.sum("size")).collect()[0][0] or 0
        shards = max(SHARDS, 1 << max(0, words // SHARD_WORDS).bit_length())
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeat)
    s = F.col("source_size")
    goal = goal.withColumn("copies", F.when(s > 0, F.floor(F.col("target") / F.greatest(s, F.lit(1)))).otherwise(0).cast("int")).withColumn("rest", F.when(s > 0, F.col("target") - F.col("copies") * s).otherwise(0.0)).withColumn("n_blocks", F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(s / block_words))).cast("int"))
    goal = materialize(goal, "targets")
    keyed = rows.withColumnRenamed("source", "src").join(_small(goal), F.col("src").eqNullSafe(F.col("source"))).select("size", "h", "k", "copies", "rest", F.pmod("h", "n_blocks").cast("int").alias("b"))
    # Blocks in permuted order: whole up to the rest that is due beyond whole copies; the one that holds the end is taken in part.
    blocks = keyed.groupBy("k", "b", "copies", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed + 1), "k", "b"), "b")) - F.col("words")
    blocks = blocks.withColumn("left", F.greatest(F.col("rest") - upto, F.lit(0.0))).withColumn("drawn", F.col("copies") + (F.col("left") > 0).cast("int"))
    blocks = materialize(blocks, "blocks")
    bounds = split_tree(blocks.groupBy("k").agg(F.sum("drawn").alias("q")), shards, seed)
    tickets = blocks.where("drawn > 0").select("k", "b", F.explode(F.sequence(F.lit(0), F.col("drawn") - 1)).alias("copy"))
    tickets = tickets.withColumn("t", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed + 2), "k", "b", "copy"), "b", "copy")) - 1)
    tickets = tickets.join(bounds, "k").select("k", "b", "copy", F.size(F.filter("bounds", lambda x: x <= F.col("t"))).alias("shard"))
    drawn = tickets.groupBy("k", "b").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("placements"))
    drawn = materialize(blocks.where("drawn > 0").select("k", "b", "left", "words", "copies").join(drawn, ["k", "b"]), "drawn")
    ends = materialize(_ends(keyed, drawn, block_words, seed), "ends")
    release(docs.sparkSession)
    return Plan(rows, goal, drawn.drop("copies"), ends, seed)


def _ends(keyed: DataFrame, drawn: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(h, placements) of the rows in blocks that are taken in part. A large one is cut into smaller blocks first, which are
    taken whole in permuted order but for one; there rows go in hash order while they fit, more passes fill the gap from
    those left over, the last by the nearer side."""
    part = drawn.where("left > 0 and left < words")
    units = keyed.select("k", "b", "h", "size").join(_small(part), ["k", "b"]).groupBy("k", "b", "h", "left", "words", "copies", "placements").agg(F.sum("size").alias("size"))
    cells = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.floor(F.col("words") / (2 * block_words)))).cast("int")
    units = units.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + 4), "h"), cells))
    cells = units.groupBy("k", "b", "cell", "left").agg(F.sum("size").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("k", "b").orderBy(F.xxhash64(F.lit(seed + 5), "cell"), "cell")) - F.col("held")
    cells = cells.select("k", "b", "cell", "held", F.greatest(F.col("left") - upto, F.lit(0.0)).alias("due"))
    units = units.drop("left").join(cells, ["k", "b", "cell"]).withColumn("taken", F.col("due") >= F.col("held"))
    sure = units.where((F.col("due") <= 0) | F.col("taken"))
    ends = units.where((F.col("due") > 0) & ~F.col("taken")).withColumn("gap", F.col("due"))
    within = Window.partitionBy("k", "b", "cell")
    for last in (False, False, False, True):
        open_ = ~F.col("taken") & (F.col("size") <= F.col("gap") * (2 if last else 1))
        ends = ends.withColumn("open", open_).withColumn("sum", F.sum(F.when(F.col("open"), F.col("size"))).over(within.orderBy(F.col("open").desc(), "size" if last else "h", "h").rowsBetween(Window.unboundedPreceding, 0)))
        ends = ends.withColumn("taken", F.col("taken") | (F.col("open") & (F.col("sum") - (F.col("size") / 2 if last else F.lit(0)) <= F.col("gap"))))
        ends = ends.withColumn("gap", F.col("due") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))).over(within), F.lit(0)))
    placements = F.when(F.col("taken"), F.col("placements")).otherwise(F.filter("placements", lambda x: x.copy < F.col("copies")))
    return sure.select("h", placements.alias("placements")).unionByName(ends.select("h", placements.alias("placements")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per row of docs: (doc_id, source, size, source_size, target, placements array<struct<copy, shard>>). options: those of plan()."""
    made = plan(docs, **options)
    none = F.expr("cast(array() as array<struct<copy: int, shard: int>>)")
    return _with_placements(made.sizes, made).select("doc_id", "source", "size", "source_size", "target", F.coalesce("placements", none).alias("placements"))


def _drawn_rows(docs: DataFrame, made: Plan, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), _unit(F.col(id_col), F.col(source_col), F.col(text_col), made.seed).alias("h"))
    out = _with_placements(rows, made).select("row", "h", F.inline("placements"))
    return out.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(made.seed + 3), "h", "copy"))


def shuffled(docs: DataFrame, made: Plan, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row of docs per placement, with shard and copy, shuffled within each shard."""
    return _drawn_rows(docs, made, id_col, text_col, source_col).select("row.*", "shard", "copy")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix is written shard by shard; what a document's rows there hold is what is taken of it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    made = plan(docs)
    written = materialize(_drawn_rows(docs, made, "doc_id", "text", "source"), "mix")
    copies = written.groupBy("h").agg(F.count(F.lit(1)).alias("drawn"))
    alike = made.sizes.groupBy("h").agg(F.count(F.lit(1)).alias("alike")).join(copies, "h").select("h", F.expr("drawn div alike").alias("n"))
    goal = _small(made.goal.select(F.col("source").alias("_source"), "source_size", "target"))
    out = made.sizes.join(alike, "h", "left").join(goal, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("n", F.lit(0))).alias("taken"))
