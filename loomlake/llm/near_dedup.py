"""Near-duplicate documents: many universal hash minima, banding, signature verification, full sets, components.

A text is lower-cased (A-Z) and split into words at ASCII white space; its set holds the distinct runs of five words, or
all of its words as one run where there are fewer. Documents of equal sets form a class, of which the smallest doc_id
takes part in the search. 32 bands of 4 minima find classes that share a band; a pair with a similarity of 0.75 is missed
with a probability of (1 - 0.75^4)^32 = 5e-6. Candidates are estimated on their signatures, and every link is confirmed
on the full sets.

No bucket is expanded into its pairs. In each bucket the members are paired with one hub, the member that meets most others
in all of its buckets; each class first confirms only its best estimate, and components are formed. What then still lies apart from
its hub is compared with all members of the hub's buckets, block by block: signatures choose, full sets confirm, and of the
links only those that join components are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import WordHashes, likely, slices, small_batches, text_column, texts_of, windows, word_hashes, written
from loomlake.llm.components import components

WIDTH = 5
BANDS, ROWS = 32, 4
N_HASHES = BANDS * ROWS
#: Links are similarities of at least PART in WHOLE.
PART, WHOLE = 75, 100
#: Pairs whose signatures agree in less than this part are not confirmed: 5 standard deviations below 0.75.
LEAST_ESTIMATE = 0.55
#: Bytes of the texts, and members, of a block at most, about; two blocks meet in one group.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 2048
#: Candidates of a member whose full sets are compared at once.
STEP = 64
#: Parts into which the members of a hub are dealt before they learn of its blocks.
SALTS = 16
#: Classes of more than one in HOT of all rows are broadcast, of which there are fewer than HOT.
HOT = 4096

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_set(data: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = word_hashes(data.lower(), hashes)
    if not len(words):
        return words
    return np.unique(windows(words, min(WIDTH, len(words))))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the universal hashes a * x + b (mod 2^32) over a set that is not empty; its low 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[None, at : at + 1024] * _A + _B).min(axis=1), out=out)
    return out.astype(np.uint16)


#: bands: the minima, of 16 bits each; the four of a band are one number, its bucket.
SKETCH = "n long, set_key binary, bands array<long>"


def _sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for texts in slices(batches):
        sizes, keys, bands = [], [], []
        for t in texts_of(texts):
            s = shingle_set(t, hashes)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(minima(s).view(np.int64) if len(s) else None)
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["n", "set_key", "bands"])


def _estimate(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of the minima in which two signatures agree."""
    x, y = (c.flatten().to_numpy().view(np.uint16).reshape(-1, N_HASHES) for c in (a, b))
    return pa.array((x == y).mean(axis=1))


def _linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for left, right in slices(batches, 1):
        out, last, kept = [], None, None
        for a, b in zip(texts_of(left), texts_of(right), strict=True):
            if a != last:  # pairs of one hub follow each other
                last, kept = a, shingle_set(a, hashes)
            s = shingle_set(b, hashes)
            common = len(np.intersect1d(kept, s, assume_unique=True))
            out.append(bool(common) and WHOLE * common >= PART * (len(kept) + len(s) - common))
        yield pa.array(out, pa.bool_())


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (hub, rep) whose full sets are similar enough, as (u, v). texts: (doc_id, text), each row once.

    The text of a rep is shuffled to its pair and with it to its hub, that of a hub once: no text meets a list of pairs.
    """
    reps, hubs = pairs.select(F.col("rep").alias("doc_id")).distinct(), pairs.select(F.col("hub").alias("doc_id")).distinct()
    of_rep = likely(texts, "doc_id", reps).select(F.col("doc_id").alias("rep"), F.col("text").alias("b")).join(pairs, "rep")
    of_hub = likely(texts, "doc_id", hubs).join(hubs, "doc_id").select(F.col("doc_id").alias("hub"), F.col("text").alias("a"))
    both = of_rep.join(of_hub, "hub").where(F.arrow_udf(_linked, "boolean")("a", "b"))
    return both.select(F.least("hub", "rep").alias("u"), F.greatest("hub", "rep").alias("v")).distinct()


def _counts_in(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each of `sets`, none of them empty, has in common with the sorted set `own`."""
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))


def _joins(block: pa.Table) -> pa.Table:
    """Links (u, v) between members of a block that lie in different components, at most one for two components.

    Every row of `is_left` meets the others, but two open members only once. Signatures choose candidates, the full sets
    decide; what a link has joined is not compared any more.
    """
    hashes, out = WordHashes(), []
    is_left = block.column("is_left").to_numpy()
    a, b = block.filter(pa.array(is_left)), block.filter(pa.array(~is_left))
    if a.num_rows and b.num_rows:
        column = lambda t, name: t.column(name).to_numpy()
        sets = [shingle_set(t, hashes) for t in texts_of(b)]
        sigs = np.stack([minima(s) for s in sets])
        sizes, reps, twice = np.array([len(s) for s in sets]), column(b, "rep"), column(b, "is_open")
        roots = np.unique(np.r_[column(a, "comp"), column(b, "comp")], return_inverse=True)[1]
        for i, (rep, text) in enumerate(zip(column(a, "rep").tolist(), texts_of(a), strict=True)):
            own = shingle_set(text, hashes)
            n = len(own)
            near = (WHOLE * np.minimum(sizes, n) >= PART * np.maximum(sizes, n)) & ~(twice & (reps <= rep)) & (roots[a.num_rows :] != roots[i])
            at = np.flatnonzero(near)
            e = (sigs[at] == minima(own)).mean(axis=1)
            at = at[np.argsort(-e, kind="stable")[: int((e >= LEAST_ESTIMATE).sum())]]
            while len(at):
                now, at = at[:STEP], at[STEP:]
                common = _counts_in(own, [sets[k] for k in now])
                for k in now[WHOLE * common >= PART * (n + sizes[now] - common)]:
                    if roots[a.num_rows + k] != roots[i]:
                        roots[roots == roots[a.num_rows + k]] = roots[i]
                        out.append((min(rep, int(reps[k])), max(rep, int(reps[k]))))
                at = at[roots[a.num_rows + at] != roots[i]]
    return pa.table([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])


def _rest(members: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that join what shares a bucket and still lies in different components.

    members: (rep, hub). All members of the buckets of one hub are its family, so that those who share many buckets meet
    once. The members outside the hub's component meet the whole family; both sides are cut by a hash into blocks of about
    BLOCK_BYTES of text or BLOCK_ROWS members, and each pair of blocks is one group. The members of a hub are joined with what concerns it in
    SALTS parts, and only texts of families with open members are shuffled.
    """
    comp_of = lambda name: comps.select(F.col("node").alias(name), F.col("component").alias(f"{name}_comp"))
    rows = members.select("hub", "rep").distinct().join(comp_of("rep"), "rep", "left").join(comp_of("hub"), "hub", "left")
    rows = rows.select("hub", "rep", F.coalesce("rep_comp", "rep").alias("comp"), (F.coalesce("rep_comp", "rep") != F.coalesce("hub_comp", "hub")).alias("is_open"))
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")), "families")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = rows.join(rows.where("is_open").select("hub").distinct().select("hub", salts), ["hub", "salt"], "left_semi")
    rows = written(rows, "families")
    needed = rows.select(F.col("rep").alias("doc_id")).distinct()
    own = likely(texts, "doc_id", needed).join(needed, "doc_id", "left_semi")
    own = written(own.select(F.col("doc_id").alias("rep"), "text", F.octet_length("text").cast("long").alias("bytes")), "texts")
    rows = written(rows.join(own.groupBy("rep").agg(F.sum("bytes").alias("bytes")), "rep"), "families")
    parts = lambda size, n: F.greatest(F.ceil((size + F.lit(1)) / BLOCK_BYTES), F.ceil((n + F.lit(1)) / BLOCK_ROWS)).cast("int")
    is_open = F.col("is_open").cast("long")
    cuts = rows.groupBy("hub").agg(parts(F.sum("bytes"), F.count("*")).alias("n_right"), parts(F.sum(is_open * F.col("bytes")), F.sum(is_open)).alias("n_left"))
    rows = rows.drop("bytes").join(cuts.select("*", salts), ["hub", "salt"])
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ["hub", "rep", "comp", "is_open"]
    right = rows.select(*common, F.lit(False).alias("is_left"), block("n_right").alias("j"), every("n_left").alias("i"))
    left = rows.where("is_open").select(*common, F.lit(True).alias("is_left"), every("n_right").alias("j"), block("n_left").alias("i"))
    both = right.unionByName(left).join(own.select("rep", "text"), "rep")
    return both.groupBy("hub", "i", "j").applyInArrow(_joins, "u long, v long").distinct()


def _once(texts: DataFrame, sketched: DataFrame) -> DataFrame:
    """texts (doc_id, text) without repeated rows; only those of ids that stand on several rows are looked at."""
    several = sketched.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    several = written(several, "repeated")
    if several.isEmpty():
        return texts
    others = texts.join(several, "doc_id", "left_anti")
    return written(others.union(likely(texts, "doc_id", several).join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])), "once")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    A null or empty text has the empty set and no link. A row without doc_id takes part in no link: its component_id is
    null and it is kept. Repeated rows count as one document and all get its row. A doc_id with several texts is one
    document that has the links of all of them. Other columns are not read. An empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    sketched = plain.select("doc_id", F.arrow_udf(_sketch, SKETCH)("text").alias("s"))
    sketched = written(sketched.select("doc_id", "s.*"), "sketches")

    named = sketched.where("doc_id IS NOT NULL AND n > 0")
    classes = written(named.groupBy("set_key", "n", "bands").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")

    bands = classes.select("rep", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(bands.join(sizes, "key"), "buckets")
    # texts without a word have no class, though their doc_id may have others
    texts = _once(plain.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), sketched)
    # the text that copies were made from meets more of them than they meet each other: it is the hub of all its buckets
    weights = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weights, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    members = written(shared.join(hubs, "key"), "members")

    pairs = members.where("rep <> hub").groupBy(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).agg(F.min("hub").alias("hub"))
    side = lambda name: classes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("bands").alias(f"sig_{name}"))
    pairs = pairs.join(side("u"), "u").join(side("v"), "v")
    pairs = pairs.where(F.lit(WHOLE) * F.least("n_u", "n_v") >= F.lit(PART) * F.greatest("n_u", "n_v"))
    # not deterministic for Catalyst, which else estimates once for the filter and again, in a second worker, for the column
    estimate = F.arrow_udf(_estimate, "double").asNondeterministic()
    pairs = pairs.select("u", "v", "hub", estimate("sig_u", "sig_v").alias("e")).where(F.col("e") >= LEAST_ESTIMATE)
    pairs = written(pairs.groupBy("u", "v", "hub").agg(F.max("e").alias("e")), "pairs")

    # a doc_id with several texts joins the classes of all of them; only such ids are joined with their classes
    of_id = F.xxhash64("set_key", "n")
    several = named.groupBy("doc_id").agg(F.min(of_id).alias("a"), F.max(of_id).alias("b")).where("a <> b").select("doc_id")
    reps = written(named.select("doc_id", "set_key").join(several, "doc_id", "left_semi"), "several").join(classes.select("set_key", "rep"), "set_key")
    edges = reps.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()

    rep = F.when(F.col("hub") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("rep")
    ends = pairs.select(F.col("u").alias("w"), "hub", rep, "e").union(pairs.select("v", "hub", rep, "e"))
    best = ends.groupBy("w").agg(F.max_by(F.struct("hub", "rep"), F.struct("e", "hub", "rep")).alias("p")).select("p.*").distinct()
    edges = written(edges.union(_confirmed(written(best, "best"), texts)), "links")
    comps = components(edges)

    # most joins by a best estimate; what remains apart within a family meets in blocks
    edges = written(edges.union(_rest(members, comps, texts)), "links")
    comps = components(edges)

    of_class = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = written(of_class.groupBy("set_key").agg(F.min(F.coalesce("component", "rep")).alias("least"), F.sum("copies").alias("copies")), "least")
    # copies of one text may be a third of all rows, and so may rows without a set: neither are shuffled by it
    most = sketched.count() // HOT
    hot = F.broadcast(of_class.where(F.col("copies") > most).select("set_key", "least"))
    rows = sketched.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    keyed = rows.where("set_key IS NOT NULL")
    others = keyed.join(hot.select("set_key"), "set_key", "left_anti").join(of_class.where(F.col("copies") <= most).select("set_key", "least"), "set_key", "left")
    out = rows.where("set_key IS NULL").withColumn("least", F.lit(None).cast("long"))
    out = out.unionByName(keyed.join(hot, "set_key")).unionByName(others)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near duplicates of one with a smaller doc_id; all columns stay.

    Repeated rows of one doc_id are one document and stay or go together. Rows without an id stay, as do null and empty
    texts. A column of docs may have any name.
    """
    gone = written(near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
