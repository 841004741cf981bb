"""Benchmark decontamination by suffix arrays of the training texts.

Each slice of documents is one shard: its texts become one array of words, and its suffixes are sorted by their first
WINDOW words. Every suffix of the benchmark is binary-searched in the shard; matches that follow each other on one diagonal
(the same distance between the place in the text and the place in the item) are one longest verbatim match, with its item,
both places and its length. The array is sparse: a suffix whose first two words open no benchmark suffix can't match, and
is left out before sorting.

Words of the benchmark are numbered, and only they: other words and the ends of documents are 0, which never matches.
The benchmark is sent to the workers in blocks of BLOCK_WORDS words; with several blocks the documents are written after
each, so that no worker holds more than one block and no documents are shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import segments, slices, texts_of, written

WINDOW = 10
#: Words of benchmark items in one block, about 100 MB in a worker; a block ends with the item that reaches it.
BLOCK_WORDS = 1_000_000

#: Bytes that part words: all of ASCII but digits and lower-case letters (upper-case ones are lower-cased before).
_PARTS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_PARTS, b" " * len(_PARTS))
_NO_WORD = bytes(c for c in range(128) if not chr(c).isalnum())


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_TABLE).split()


class Block:
    """Suffixes of some benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.window = window
        self.items: list[str | None] = []
        self.begins: list[int] = []
        words: list[int] = [0]
        # suffixes by their first words: window -> places in the block
        places: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            k = min(window, len(ids))
            self.items.append(item_id)
            self.begins.append(len(words))
            for i in range(len(ids) - k + 1 if k else 0):
                places[tuple(ids[i : i + k])].append(len(words) + i)
            words += [*ids, 0]
        self.words, self.begins = np.array(words, np.int64), np.array(self.begins, np.int64)
        # the windows of each length in order; the places of the n-th are flat[cuts[n] : cuts[n + 1]]
        self.lengths = {}
        for k in sorted({len(t) for t in places}):
            keys = sorted(t for t in places if len(t) == k)
            cuts = np.cumsum([0, *[len(places[t]) for t in keys]])
            self.lengths[k] = (_rows(np.array(keys, np.uint32)), np.array([p for t in keys for p in places[t]], np.int64), cuts)
        size = len(self.vocab) + 1
        firsts = {(t[0], t[1] if len(t) > 1 else None) for t in places}
        self.single = np.zeros(size, bool)
        self.single[[a for a, b in firsts if b is None]] = True
        self.starts = np.zeros(size, bool)
        self.starts[[a for a, b in firsts if b is not None]] = True
        self.pairs = np.unique(np.array([a * size + b for a, b in firsts if b is not None], np.int64))

    def numbered(self, text: bytes) -> np.ndarray:
        """Numbers of the words of a text; a long one is taken piece by piece."""
        get = self.vocab.get
        parts = [words_of(x) for x in segments(text, _NO_WORD)]
        return np.fromiter((get(w, 0) for x in parts for w in x), np.int64, sum(map(len, parts)))


def _rows(a: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings of the same order."""
    b = np.ascontiguousarray(a.astype(">u4"))
    return b.view(f"V{4 * a.shape[1]}").ravel() if len(b) else np.empty(0, f"V{4 * a.shape[1]}")


class SuffixArray:
    """The suffixes of a shard that may begin a match, sorted by their first words."""

    def __init__(self, words: np.ndarray, block: Block):
        self.words, size = words, len(block.vocab) + 1
        after = np.r_[words[1:], 0]
        at = np.flatnonzero(block.starts[words] & (after > 0))
        pairs = words[at] * size + after[at]
        if len(block.pairs):
            near = np.searchsorted(block.pairs, pairs)
            at = at[block.pairs[np.minimum(near, len(block.pairs) - 1)] == pairs]
        at = np.union1d(at, np.flatnonzero(block.single[words]))
        padded = np.r_[words, np.zeros(block.window, np.int64)].astype(np.uint32)
        keys = padded[at[:, None] + np.arange(block.window)]
        order = np.lexsort(keys.T[::-1]) if len(at) else at
        self.at, self.keys = at[order], keys[order]

    def find(self, needles: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each needle (rows of `width` words) the range of suffixes that begin with it."""
        own = _rows(self.keys[:, :width]).view(f"S{4 * width}") if len(self.keys) else np.empty(0, f"S{4 * width}")
        needles = needles.view(f"S{4 * width}")
        return np.searchsorted(own, needles, "left"), np.searchsorted(own, needles, "right")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of every i, sizes[i] of them, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def matches(array: SuffixArray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard, place in the block, length) of the longest verbatim matches, of a window at least."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, (needles, flat, cuts) in block.lengths.items():
        lo, hi = array.find(needles, k)
        n = np.flatnonzero(hi > lo)
        if not len(n):
            continue
        # every place in the shard with every place in the block that has the same words
        many = (cuts[1:] - cuts[:-1])[n]
        p = array.at[_ranges(lo[n], (hi - lo)[n])]
        each = np.repeat(many, (hi - lo)[n])
        q = flat[_ranges(np.repeat(cuts[n], (hi - lo)[n]), each)]
        p = np.repeat(p, each)
        order = np.lexsort((p, p - q))
        p, q = p[order], q[order]
        first = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(p - q) != 0)])
        found.append((p[first], q[first], np.diff(np.r_[first, len(p)]) + k - 1))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _search(block: Block, texts: list[bytes]) -> Iterator[tuple[int, list[dict]]]:
    """For each text its number of words and its matches."""
    numbered = [block.numbered(t) for t in texts]
    sizes = np.array([len(x) for x in numbered], np.int64)
    begins = np.r_[0, np.cumsum(sizes + 1)[:-1]] if len(sizes) else sizes  # a 0 ends each document
    shard = np.concatenate([np.r_[x, 0] for x in numbered]) if len(sizes) else sizes
    own: dict[int, list[dict]] = defaultdict(list)
    p, q, lengths = matches(SuffixArray(shard, block), block)
    docs, items = np.searchsorted(begins, p, "right") - 1, np.searchsorted(block.begins, q, "right") - 1
    for d, i, at, item_at, n in zip(docs.tolist(), items.tolist(), (p - begins[docs]).tolist(), (q - block.begins[items]).tolist(), lengths.tolist(), strict=True):
        own[d].append({"item": block.items[i], "item_at": item_at, "at": at, "length": n})
    for d, n in enumerate(sizes.tolist()):
        yield n, own.get(d, [])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks of a bounded size. Spark counts the words and numbers the blocks, and each comes by itself."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array([sum(len(words_of(x)) for x in segments(t, _NO_WORD)) for t in texts_of(texts)], pa.int64())

    text = F.col(text_col).cast("string")
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.arrow_udf(count, "long")(text).alias("n")).where("n > 0")
    rows = written(rows.withColumn("part", F.spark_partition_id()), "benchmark")
    within = Window.partitionBy("part").orderBy("id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy("part").agg(F.sum("n").alias("m"))
    # a row for each partition of the benchmark
    before = parts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    numbered = rows.withColumn("upto", F.sum("n").over(within)).join(before, "part")
    numbered = written(numbered.select("id", "text", F.floor((F.col("before") + F.col("upto") - F.col("n")) / BLOCK_WORDS).alias("block")), "benchmark")
    blocks = sorted(r.block for r in numbered.select("block").distinct().collect())
    for k in blocks:
        yield Block([(r.id, r.text.encode()) for r in numbered.where(F.col("block") == k).orderBy("id", "text").collect()])
    if not blocks:
        yield Block([])


_MATCH = [("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]
FOUND = "n_words long, matches array<struct<item:string,item_at:long,at:long,length:long>>"


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(row, text, n_words, matches): row has all columns of docs, whatever their names are."""
    cur = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    row = cur.schema["row"].dataType.simpleString()
    first = True
    for block in _blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        if not first:
            cur = written(cur, "decontaminated")

        def search(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct(_MATCH))
            for b in slices(batches):
                n_words, found = zip(*_search(sent.value, texts_of(b)), strict=True)
                if not first:
                    found = [[*x, *y] for x, y in zip(b.column("matches").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(n_words, pa.int64()), pa.array(found, kind)], names=["row", "text", "n_words", "matches"])

        cur, first = cur.mapInArrow(search, f"row {row}, text string, {FOUND}"), False
    return cur


def _hits(matches: str = "matches"):
    """The ranges of words that matches cover, merged."""

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = [[{"s": s, "e": e} for s, e in merged([(m["at"], m["at"] + m["length"]) for m in x])] for x in b.to_pylist()]
            yield pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))

    return F.arrow_udf(join, "array<struct<s:long,e:long>>")(matches)


def _items():
    """The items of the matches, each once, as strings in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda x: x.isNotNull())))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, matches, hits (ranges of words that matches cover) and items (their item_ids as strings).

    A match is (item, item_at, at, length): `length` words of an item from item_at on stand in the text from word `at` on,
    and no more of them on either side. It has WINDOW words at least, or is a whole item of fewer words; upper case and
    punctuation make no difference. A null or empty text has no words. Items without words are ignored; an item with a null
    id makes matches but is not listed. The same id may stand on several rows. Columns of docs that are named like one of
    the four give way to it. An empty table gives an empty one.
    """
    new = ("n_words", "matches", "hits", "items")
    found = _found(docs, benchmark, text_col, item_col, item_text)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return found.select(*own, "n_words", "matches", _hits().alias("hits"), _items().alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs, as `contamination` finds."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = contamination(own, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x.e - x.s)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark window.

    All columns stay as they are, whatever their names. Null and empty texts stay; repeated rows stay or go together.
    """
    found = _found(docs, benchmark, text_col, item_col, item_text)
    return found.where(F.size("matches") == 0).select("row.*")
