"""Alignment of the tokens of two tokenizers over the same texts, by a sweep over the places where tokens end.

Each side turns a text into its ends, as blocks of consecutive tokens that know the offset at which they begin. The blocks
of both sides are united, dealt by document, sorted by offset and streamed through a machine that keeps the tokens of the
open group, at most a block a side, and closes a group wherever both sides end. Only ids travel; how many bytes a token has
is looked up.

The id pairs of a document are counted corpus-wide. Pairs that hold HOT_PAIRS-th part of all entries or more, so HOT_PAIRS at
most, are looked up in an array that every worker has; the others are joined, and none of those is a hot key.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import slices, texts_of, written

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens of a block, and bytes of a text that are tokenized at once.
BLOCK, SEGMENT = 8192, 1 << 20
#: A pair goes to all workers if this many times its count is no less than all entries; so there are no more such pairs.
HOT_PAIRS = 1 << 20
#: Bits of an id of the second tokenizer in a pair.
B_BITS = 15
#: Rows of the compact tables that a worker takes from a batch at once.
ROWS = 512

#: Where a long text may be cut: before a single space between visible ASCII characters.
_CUT = re.compile(rb"[!-~] [!-~]")


def _parts(data: bytes) -> Iterator[bytes]:
    """data cut into parts of about SEGMENT bytes; all but the first begin with a space."""
    at = 0
    while len(data) - at > SEGMENT and (found := _CUT.search(data, at + SEGMENT)):
        yield data[at : found.start() + 1]
        at = found.start() + 1
    yield data[at:]


class _Side:
    """One tokenizer: the bytes and sizes of its ids, and the blocks of a text."""

    spelled: list[bytes]
    sizes: np.ndarray
    in_parts: bool
    #: Whether tokens always say what the text says.
    exact = False

    def ids(self, part: bytes) -> np.ndarray:
        """16-bit ids of a text, or of a part of one; both begin with a space."""
        raise NotImplementedError

    def blocks(self, data: bytes) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(offset, ids, whether the tokens say what the text says) of the blocks of a text that begins with a space."""
        offset = 0
        for part in _parts(data) if self.in_parts else [data]:
            found = self.ids(part)
            ok = self.exact or b"".join(map(self.spelled.__getitem__, found.tolist())) == part
            for k in range(0, max(1, len(found)), BLOCK):
                ids = found[k : k + BLOCK]
                yield offset, ids, ok
                offset += int(self.sizes[ids].sum())


class ByteSide(_Side):
    """A byte-level tokenizer, from a file of the tokenizers library.

    Where its merges are ordered like its ids and every token of its vocabulary is found again from its own bytes, merging
    by the ids of what is made gives the same tokens: then no two parts of a token can meet but those of its own merge. That
    is checked, and then tiktoken does it, several times faster.
    """

    in_parts = True

    def __init__(self, path: str = BYTE_TOKENIZER):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        if (split.get("type"), split.get("add_prefix_space"), split.get("use_regex"), made["normalizer"]) != ("ByteLevel", False, True, None):
            raise ValueError("the first tokenizer must be byte-level, part texts by the usual pattern and leave them as they are")
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the first tokenizer may have 65,536 ids at most")
        letters = _byte_letters()
        vocab = made["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token)}
        self.spelled = [b""] * self.tokenizer.get_vocab_size()
        for token, i in ranks.items():
            self.spelled[i] = token
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)
        self.fast = self._by_rank(made["model"], vocab, ranks)
        self.exact = self.fast is not None

    def _by_rank(self, model: dict, vocab: dict[str, int], ranks: dict[bytes, int]):
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        names = {i: x for x, i in vocab.items()}
        alone = all([t.id for t in self.tokenizer.model.tokenize(names[i])] == [i] for i in made)
        if made != sorted(set(made)) or not alone or model["dropout"] or len(made) + 256 != len(ranks) or min(made) <= max(i for x, i in ranks.items() if len(x) == 1):
            return None
        import tiktoken

        return tiktoken.Encoding("by-rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, part: bytes) -> np.ndarray:
        if self.fast:
            return np.array(self.fast.encode_ordinary(part.decode()), np.uint16)
        return np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, np.uint16)


def _byte_letters() -> dict[str, int]:
    """letter -> byte: a byte-level vocabulary writes a visible byte as itself, the others as the letters from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceSide(_Side):
    """A sentencepiece tokenizer that adds a space to its text.

    A part gives the ids that it has within its text only if no piece has a space after another letter and texts are not
    changed before they are cut into pieces; otherwise long texts are not cut into parts.
    """

    def __init__(self, path: str = PIECE_TOKENIZER):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.pieces = SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if len(names) > 1 << B_BITS:
            raise ValueError(f"the second tokenizer may have {1 << B_BITS} ids at most")
        self.spelled = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.pieces.serialized_model_proto())
        spec = model.normalizer_spec
        as_it_is = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.in_parts = as_it_is and not any("▁" in x.lstrip("▁") for x in names)

    def ids(self, part: bytes) -> np.ndarray:
        return np.array(self.pieces.encode(part[1:].decode(), num_threads=1), np.uint16)


_WORKER: dict[tuple[type, str], _Side] = {}


def _side(kind: type[_Side], path: str) -> _Side:
    if (kind, path) not in _WORKER:
        _WORKER[kind, path] = kind(path)
    return _WORKER[kind, path]


EVENTS = "row long, doc_id long, at long, side byte, ids binary, ok boolean"


def end_events(docs: DataFrame, side: int, kind: type[_Side], path: str) -> DataFrame:
    """(row, doc_id, at, side, ids, ok): the blocks of ends of one tokenizer. docs: (row, doc_id, text).

    Null and empty texts have one block without ids that is not ok.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _side(kind, path)
        for b in slices(batches):
            out: list[tuple] = []
            for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                for at, ids, ok in own.blocks(b" " + text) if text else [(0, np.zeros(0, np.uint16), False)]:
                    out.append((row, doc, at, side, zlib.compress(ids.tobytes(), 1), ok))
                    if len(out) >= ROWS:
                        yield _batch(out, EVENTS_ARROW)
                        out = []
            yield _batch(out, EVENTS_ARROW)

    return docs.mapInArrow(tokenize, EVENTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


EVENTS_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("side", pa.int8()), ("ids", pa.binary()), ("ok", pa.bool_())])


class _Sweep:
    """The machine: takes the blocks of a document in order of their offset, and gives out closed groups.

    `open` holds the ids and ends that no common end follows yet; `closed` is called with the ids of both sides and, for
    each token, the number of its group from 0 among those that are given out.
    """

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.ids = [np.zeros(0, np.uint16)] * 2
        self.ends = [np.zeros(0, np.int64)] * 2

    def take(self, side: int, at: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, group of each id) of both sides, and the ends of the groups that this block closes; None without any."""
        self.ids[side] = np.concatenate([self.ids[side], ids]) if len(self.ids[side]) else ids
        ends = np.cumsum(self.sizes[side][ids]) + at
        self.ends[side] = np.concatenate([self.ends[side], ends]) if len(self.ends[side]) else ends
        common = np.intersect1d(*self.ends, assume_unique=True)
        if not len(common):
            return None
        out = []
        for k in (0, 1):
            n = int(np.searchsorted(self.ends[k], common[-1], "right"))
            out += [self.ids[k][:n], np.searchsorted(common, self.ends[k][:n])]
            self.ids[k], self.ends[k] = self.ids[k][n:], self.ends[k][n:]
        return (*out, common)


_DIGITS = np.zeros((1 << 16, 5), np.uint8)
_WIDTH = np.ones(1 << 16, np.int64)
for _k in range(1, 6):
    _low = np.arange(10 ** (_k - 1) if _k > 1 else 0, min(10**_k, 1 << 16))
    _WIDTH[_low] = _k
    for _j in range(_k):
        _DIGITS[_low, _j] = _low // 10 ** (_k - 1 - _j) % 10 + 48


def groups_text(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3;`: ids of groups in decimal, each group with a semicolon after it."""
    both, group = np.concatenate([a, b]), np.concatenate([2 * ga, 2 * gb + 1])
    order = np.argsort(group, kind="stable")
    both, group = both[order], group[order]
    last = np.append(group[1:] != group[:-1], True)
    out = np.zeros((len(both), 6), np.uint8)
    out[:, :5] = _DIGITS[both]
    width = _WIDTH[both]
    out[np.arange(len(both)), width] = np.where(~last, ord(","), np.where(group % 2 == 0, ord("|"), ord(";")))
    return out[np.arange(6) <= width[:, None]].tobytes()


def links(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts): the different (A id, B id) pairs within groups, as A id << B_BITS | B id, and how often each occurs."""
    nb = np.bincount(gb)
    first = np.concatenate([[0], np.cumsum(nb)[:-1]])
    times = nb[ga]
    stop = np.cumsum(times)
    j = np.arange(stop[-1]) - np.repeat(stop - times, times) + np.repeat(first[ga], times)
    return np.unique(np.repeat(a.astype(np.int32), times) << B_BITS | b[j].astype(np.int32), return_counts=True)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in parts]))
    return pairs, counts


_NO_PAIRS = (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _packed(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(pairs, prepend=np.int32(0)).astype("<i4").tobytes() + counts.astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<i4").reshape(2, -1)
    return np.cumsum(both[0], dtype=np.int32), both[1]


def _in_order(docs: DataFrame, id_col: str, text_col: str, tokenizers: tuple[str, str]) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = end_events(rows, 0, ByteSide, tokenizers[0]).unionByName(end_events(rows, 1, PieceSide, tokenizers[1]))
    return both.repartition("row").sortWithinPartitions("row", "at", "side")


def _documents(batches: Iterator[pa.RecordBatch], sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """(row, doc_id, closed groups or None, whether the document ends here, whether its tokens say its text)."""
    now, doc, ok, sweep = None, None, True, _Sweep(sizes)
    for b in batches:
        for row, own, at, side, ids, good in zip(*[b.column(c).to_pylist() for c in ("row", "doc_id", "at", "side", "ids", "ok")], strict=True):
            if row != now:
                if now is not None:
                    yield now, doc, None, True, ok and not len(sweep.ids[0]) + len(sweep.ids[1])
                now, doc, ok, sweep = row, own, True, _Sweep(sizes)
            ok &= good
            if ok:
                closed = sweep.take(side, at, np.frombuffer(zlib.decompress(ids), np.uint16))
                if closed:
                    yield now, doc, closed, False, ok
    if now is not None:
        yield now, doc, None, True, ok and not len(sweep.ids[0]) + len(sweep.ids[1])


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
_ALIGNED_ARROW = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("pairs", pa.binary())])


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (BYTE_TOKENIZER, PIECE_TOKENIZER)) -> DataFrame:
    """A row for each document: its counts, the digest of its groups, and its id pairs with their counts, packed."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = (_side(ByteSide, tokenizers[0]).sizes, _side(PieceSide, tokenizers[1]).sizes)
        out: list[tuple] = []
        n, digest, parts, tail = [0, 0, 0, 0], hashlib.sha256(), [], b""
        for row, doc, closed, ends, ok in _documents(batches, sizes):
            if not ends:
                a, ga, b, gb, common = closed
                text = tail + groups_text(a, ga, b, gb)
                digest.update(text[:-1])
                tail = text[-1:]  # the semicolon counts only if another group follows
                pairs, counts = links(a, ga, b, gb)
                parts = [*parts, (pairs, counts)] if len(parts) < 8 else [_merge([*parts, (pairs, counts)])]
                n = [x + y for x, y in zip(n, (len(a), len(b), len(common), int(counts.sum())), strict=True)]
                continue
            if ok:
                out.append((row, doc, *n, digest.hexdigest(), _packed(*_merge(parts or [_NO_PAIRS]))))
            else:
                out.append((row, doc, 0, 0, 0, 0, "", _packed(*_NO_PAIRS)))
            n, digest, parts, tail = [0, 0, 0, 0], hashlib.sha256(), [], b""
            if len(out) >= ROWS:
                yield _batch(out, _ALIGNED_ARROW)
                out = []
        yield _batch(out, _ALIGNED_ARROW)

    return _in_order(docs, id_col, text_col, tokenizers).mapInArrow(sweep, ALIGNED)


GROUPS = "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>"


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (BYTE_TOKENIZER, PIECE_TOKENIZER)) -> DataFrame:
    """(doc_id, start, end, a_ids, b_ids): the groups of every document, with places in bytes of a space and the text.

    A document whose tokens do not say what its text says has no groups from the block on in which they differ.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = (_side(ByteSide, tokenizers[0]).sizes, _side(PieceSide, tokenizers[1]).sizes)
        at, ints = 0, pa.list_(pa.int32())
        for _, doc, closed, ends, _ in _documents(batches, sizes):
            if ends:
                at = 0
                continue
            a, ga, b, gb, common = closed
            starts = np.concatenate([[at], common[:-1]])
            own = [pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(g, np.arange(len(common))), len(g)), pa.int32()), pa.array(ids.astype(np.int32))) for ids, g in ((a, ga), (b, gb))]
            at = int(common[-1])
            columns = [pa.array([doc] * len(common), pa.int64()), pa.array(starts, pa.int64()), pa.array(common, pa.int64()), *[x.cast(ints) for x in own]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "a_ids", "b_ids"])

    return _in_order(docs, id_col, text_col, tokenizers).mapInArrow(sweep, GROUPS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether none of its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                own = np.concatenate([_NO_PAIRS[0], *[_unpacked(x)[0] for x in b.column("pairs").slice(at, ROWS).to_pylist()]])
                parts.append(np.unique(own, return_counts=True))
                held += len(parts[-1][0])
                if held > 1 << 21:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0]), pa.array(parts[0][1].astype(np.int64))], names=["pair", "n"])
                        parts, held = [], 0
        if parts:
            pairs, n = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = aligned.select("pairs").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "pairs")
    most = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("most"))
    return written(counts.join(most, F.shiftright("pair", B_BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best-pairs")


SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, cold array<struct<pair: int, times: int>>"


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (BYTE_TOKENIZER, PIECE_TOKENIZER)) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs.

    A is tokenizers[0] over a space and the text, B is tokenizers[1] over the text. Null and empty texts, and those whose
    tokens do not say what the text says, have zeros and an empty digest. Ids may be null or repeated: every row is a
    document of its own. Other columns are not read. An empty table gives an empty one. docs is read once for each
    tokenizer, and rows are numbered in the order in which Spark reads them: it must be a table or a written result.
    """
    spark = docs.sparkSession
    aligned = written(aligned_documents(docs, id_col, text_col, tokenizers), "aligned")
    counts = pair_counts(aligned)
    entries = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") >= F.lit(entries / HOT_PAIRS)
    # no more than HOT_PAIRS rows
    hot = counts.where(is_hot).orderBy("pair").toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                bests, sums, cold, sizes = [], [], [np.zeros((0, 2), np.int32)], [0]
                for data in b.column("pairs").to_pylist():
                    pairs, times = _unpacked(data)
                    at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                    found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                    at, own = at[found], times[found].astype(np.int64)
                    bests.append(int(own[best[at]].sum()))
                    sums.append(int((own * n[at]).sum()))
                    cold.append(np.stack([pairs[~found], times[~found]], 1))
                    sizes.append(len(cold[-1]))
                rest = np.concatenate(cold)
                structs = pa.StructArray.from_arrays([pa.array(rest[:, 0].astype(np.int32)), pa.array(rest[:, 1].astype(np.int32))], names=["pair", "times"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), structs)
                columns = [b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
                columns += [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), b.column("groups_sha256"), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "cold"])

    scored = aligned.mapInArrow(score, SCORED)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    cold = counts.where(~is_hot)
    if cold.isEmpty():
        return scored.select(names)
    scored = written(scored, "scored")
    rest = scored.select("row", F.inline("cold")).join(cold, "pair").groupBy("row")
    rest = rest.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return scored.join(rest, "row", "left").withColumns(more).select(names)
