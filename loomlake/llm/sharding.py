"""Sharding by a Hilbert curve over metadata, with DataFrame functions only.

Four columns of metadata are quantised at quantiles of all rows (strings by the ranks of their distinct values), their bins
are one cell of a cube, and the cells follow each other along the Hilbert curve. Rows are cut into runs along it, so a
shard covers a compact box of every column and a reader that filters on any of them skips most files. Law `rows`: the
counts of shards differ by one at most.

Rows of equal texts are one group, which lies where the first of its cells lies, so that a group is cut only by the end of
a shard. Ranks need no global sort: the groups of a cell are dealt by a hash to pieces of about 1/PARTS of all rows, a
group that is larger by itself (a third of the rows may be one text) is dealt by a hash of the row, and only the counts of
these pieces are summed up over the whole table. There are at most CELLS + 3 * PARTS of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.llm.common import written

BITS = 3
PARTS = 4096
#: Rows of a written file, about; a shard has as many files as it needs.
FILE_ROWS = 1_000_000


def _string_cuts(docs: DataFrame, column: str, bins: int) -> list[str]:
    """The last value of each bin but the last, when the rows are cut into bins of about equal size in order of the value.

    Distinct values are counted, sorted into ranges, and their counts summed up within each range and over the ranges; of
    the values no more than a few reach the driver.
    """
    values = docs.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    values = written(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    # a row for each range
    parts = values.groupBy("part").agg(F.sum("n").alias("m"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = values.agg(F.sum("n")).first()[0] or 0
    before = parts.select("part", (F.sum("m").over(every) - F.col("m")).alias("before"))
    within = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("upto", F.sum("n").over(within)).join(before, "part")
    # a value lies in the bin of its middle row
    at = F.floor((F.col("before") + F.col("upto") - F.col("n") / 2) * bins / F.lit(max(total, 1)))
    return sorted(r.cut for r in placed.groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.max("value").alias("cut")).collect())[:-1]


def _number_cuts(docs: DataFrame, columns: list[Column], bins: int) -> list[list[int]]:
    at = [k / bins for k in range(1, bins)]
    row = docs.agg(*[F.percentile_approx(c, at, 10_000).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [row[f"m{i}"] or [] for i in range(len(columns))]


def _bin(value: Column, cuts: list) -> Column:
    """How many cuts lie below the value; 0 for null."""
    return sum((F.when(value > F.lit(cut), F.lit(1)).otherwise(F.lit(0)) for cut in cuts), F.lit(0)).cast("long")


def hilbert_cells(spark: SparkSession, dims: int, bits: int = BITS) -> DataFrame:
    """(cell, index): the place on the Hilbert curve of each cell; a cell packs its bins, the first dimension highest.

    Skilling's transform, one step a column expression, over the 2^(dims * bits) cells alone.
    """
    cells = spark.range(1 << (dims * bits)).withColumnRenamed("id", "cell")
    x = [f"x{i}" for i in range(dims)]
    cells = cells.select("cell", *[F.shiftright("cell", bits * (dims - 1 - i)).bitwiseAND(F.lit((1 << bits) - 1)).alias(x[i]) for i in range(dims)])
    for b in range(bits - 1, 0, -1):
        low = F.lit((1 << b) - 1)
        for i in range(dims):
            is_set = F.col(x[i]).bitwiseAND(F.lit(1 << b)) != 0
            t = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(low)
            first = F.when(is_set, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(t))
            own = F.when(is_set, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(t))
            cells = cells.withColumns({x[0]: first, x[i]: own} if i else {x[0]: F.when(is_set, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]))})
    for i in range(1, dims):
        cells = cells.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    last = F.col(x[-1])
    t = reduce(lambda acc, b: acc.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0))), range(bits - 1, 0, -1), F.lit(0))
    cells = cells.withColumn("t", t)
    gray = [F.col(c).bitwiseXOR(F.col("t")) for c in x]
    place = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for g in gray:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(g, b).bitwiseAND(F.lit(1)).cast("long"))
    return cells.select("cell", place.alias("index"))


def hilbert_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs.

    A null text has no bytes and is one group with the empty ones. Nulls of a metadata column share its lowest bin. Repeated
    rows, and rows without an id, each get a place of their own. Other columns are not read. An empty table gives an empty
    one; with fewer rows than shards, the shards hold one row or none.
    """
    spark = docs.sparkSession
    bins = 1 << BITS
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    nums = [F.col(c).cast("long") for c in (*numbers, id_col)]
    cuts = [*[(F.col(c).cast("string"), _string_cuts(docs, c, bins)) for c in strings], *zip(nums, _number_cuts(docs, nums, bins), strict=True)]
    cell = F.lit(0).cast("long")
    for column, own in cuts:
        cell = F.shiftleft(cell, BITS).bitwiseOR(_bin(column, own))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        cell.alias("cell"),
        F.monotonically_increasing_id().alias("row"),
    )
    # at most 2^(BITS * dimensions) rows
    curve = hilbert_cells(spark, len(cuts))
    rows = written(rows.join(F.broadcast(curve), "cell").drop("cell"), "rows")

    # groups of equal texts lie together, in the first of their cells
    text_key = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*text_key).agg(F.count("*").alias("n_group"), F.min("index").alias("place")).where("n_group > 1")
    # a table of its own, so that Spark may split the rows of a text that very many have
    rows = rows.join(written(groups, "groups"), text_key, "left")
    rows = written(rows.select("doc_id", "row", *text_key, F.coalesce("place", "index").alias("index"), F.coalesce("n_group", F.lit(1)).alias("n_group")), "rows")

    total = rows.count()
    most = max(64, -(-total // PARTS))
    is_hot = F.col("n_group") > most
    cells = rows.where(~is_hot).groupBy("index").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(cells), "index", "left")
    # a group of over `most` rows is a piece of its own, and cut further by the row
    part = F.when(is_hot, F.lit(-1)).otherwise(F.pmod(F.xxhash64("h", "size"), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)))).cast("int")
    split = F.when(is_hot, F.pmod(F.xxhash64("row"), F.ceil(F.col("n_group") / most))).otherwise(0).cast("int")
    rows = rows.withColumns({"part": part, "hot": F.when(is_hot, F.col("h")).otherwise(0), "split": split})

    key = ["index", "part", "hot", "split"]
    pieces = written(rows.groupBy(*key).agg(F.count("*").alias("n")), "pieces")
    of_index = pieces.groupBy("index").agg(F.sum("n").alias("m"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_index = of_index.select("index", (F.sum("m").over(upto(Window.orderBy("index"))) - F.col("m")).alias("before"))
    within = upto(Window.partitionBy("index").orderBy("part", "hot", "split"))
    pieces = pieces.withColumn("own", F.sum("n").over(within) - F.col("n")).join(F.broadcast(of_index), "index")
    pieces = pieces.select(*key, (F.col("before") + F.col("own")).alias("start"))

    local = Window.partitionBy(*key).orderBy(*text_key, "doc_id", "row")
    ranked = rows.withColumn("nth", F.row_number().over(local)).join(F.broadcast(pieces), key)
    rank = (F.col("start") + F.col("nth") - 1).cast("long")
    shard = F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L")
    # the first rank of shard s is the least r with r * n_shards >= s * total
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    out = ranked.withColumn("rank", rank).withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Writes docs with their shard, a folder for each shard, whose files hold runs of FILE_ROWS slots, about.

    Rows of one id and one text lie in one file; rows without an id are placed by their text. A column named like the
    shard gives way to it. Null and empty texts are one group. An empty table writes nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"doc_id": F.col("doc_id").cast("long"), "text_crc32": F.crc32(text.cast("binary")), "size": (F.octet_length(text) + 16).cast("long")}
    places = hilbert_shards(docs, n_shards).groupBy(*keys).agg(F.min(F.struct("shard", "slot")).alias("at"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("row"), *[c.alias(f"row_{k}") for k, c in keys.items()])
    same = reduce(lambda a, b: a & b, [F.col(f"row_{k}").eqNullSafe(F.col(k)) for k in keys])
    placed = rows.join(places, same).select("row.*", F.col("at.shard").alias("shard"), F.floor(F.col("at.slot") / FILE_ROWS).alias("_file"), F.col("at.slot").alias("_slot"))
    files = max(n_shards, -(-docs.count() // FILE_ROWS))
    # a task writes one run of a shard, sorted along the curve
    parted = placed.repartitionByRange(files, "shard", "_file").sortWithinPartitions("shard", "_slot")
    parted.drop("_file", "_slot").write.partitionBy("shard").parquet(path)
