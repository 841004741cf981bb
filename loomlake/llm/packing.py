"""Cost-balanced packing of documents into training sequences.

A document's tokens are cut into pieces of at most CAPACITY. Attention costs LINEAR * n + QUADRATIC * n^2 for a piece of
n tokens, as pieces in one sequence don't attend to each other. Descending by cost, each piece goes to the sequence of
lowest cost that has room for it. Pieces are dealt by a hash to groups of about GROUP_ROWS documents; each group is packed
by itself, so that no task's work grows with the input.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import segments, slices

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Documents that one task packs at once.
GROUP_ROWS = 20_000
#: Parts of words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 1 << 19
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# How a tokenizer must prepare texts so that words between white space are independent of each other.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Plain words have ASCII and letters of Latin-1 alone, which NFC leaves as they are; SPLIT cuts them like this in lower case.
_ODD = r"[^!-~À-ÖØ-öø-ÿ]"
_CUT = r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+"


class TokenIds(dict):
    """A part of a word between ASCII white space -> its ids, as bytes of little-endian 32-bit numbers.

    A tokenizer that drops white space and joins nothing across it is asked word by word, and each different word of a batch
    once. Plain words are cut into parts, of which its model is asked; what it said is remembered. All other words, and
    those with strings of added tokens, are left whole. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str = TOKENIZER):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        split, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        added = made["added_tokens"]
        self.by_word = (
            (made["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
            and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
            and (made["model"]["type"], made["model"]["dropout"], made["model"].get("ignore_merges")) == ("BPE", None, False)
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
            # an added token has no white space and is no part of a plain word
            and not any(re.search(r"\s", t["content"]) or re.fullmatch(f"[A-Za-zÀ-ÖØ-öø-ÿ]*|{_CUT}", t["content"].lower()) for t in added)
        )
        self.odd = "|".join([_ODD, *(re.escape(t["content"]) for t in added)])
        self.is_odd = re.compile(self.odd).search

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if self.is_odd(part):
            ids = self._whole(part)
        else:
            ids = _bytes([t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS))])
        self[part] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _each(self, found: pa.Array) -> pa.Array:
        """The ids of each of found; different ones are looked up once."""
        coded = found.dictionary_encode()
        return pa.array([self[x] for x in coded.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary()).take(coded.indices)

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each of words, none of which has white space."""
        odd = pc.match_substring_regex(words, self.odd)
        cut = pc.replace_substring_regex(pc.utf8_lower(words), _CUT, r" \0 ")
        parts = pc.ascii_split_whitespace(pc.if_else(odd, words, cut))
        return _joined(parts, self._each(parts.flatten()))

    def of(self, data: bytes) -> bytes:
        """Ids of a text, and END_ID."""
        return next(self.of_all(pa.array([data.decode()])))

    def of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, and END_ID; null is empty. A text alone may be long."""
        texts, end = texts.cast(pa.large_string()).fill_null(""), _bytes([END_ID])
        if not self.by_word:
            found = map(self._whole, texts.to_pylist())
        elif len(texts) == 1:
            found = [b"".join([x for piece in segments(texts[0].as_py().encode()) for x in self._texts(pa.array([piece], pa.large_binary()).cast(pa.large_string()))])]
        else:
            found = self._texts(texts)
        yield from (x + end for x in found)

    def _texts(self, texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        return _joined(words, self._words(coded.dictionary).take(coded.indices)).to_pylist()


def _joined(lists: pa.Array, values: pa.Array) -> pa.Array:
    """For each list the bytes of its values one after the other; values has those of all lists."""
    ends = np.append(0, np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False)))
    ends = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), values.buffers()[2] or pa.py_buffer(b"")])


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """byte -> letter: a byte-level vocabulary writes a visible byte as itself, the others as the letters from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}


_LETTERS = _byte_letters()
_WORKER: dict[str, TokenIds] = {}


def pieces_of(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, then what is left."""
    return [(i, min(CAPACITY, n - i)) for i in range(0, n, CAPACITY)]


def cost(n: np.ndarray | int):
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: in descending order, each to the sequence of lowest cost with room for it."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return sequence, offset
    order = np.argsort(-lengths, kind="stable")
    n = max(1, -(-int(lengths.sum()) // CAPACITY))
    used, costs = np.zeros(n + len(lengths), np.int64), np.zeros(n + len(lengths))
    for i in order.tolist():
        size = int(lengths[i])
        open_costs = np.where(used[:n] + size <= CAPACITY, costs[:n], np.inf)
        k = int(open_costs.argmin())
        if open_costs[k] == np.inf:
            k, n = n, n + 1
        sequence[i], offset[i] = k, used[k]
        used[k] += size
        costs[k] += cost(size)
    return sequence, offset


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_group(group: pd.DataFrame) -> pd.DataFrame:
    """All pieces of a group of documents with their sequences; its sequences are numbered from group << 32."""
    group = group.sort_values(["doc_tokens", "key", "doc_id", "nth"], ascending=[False, True, True, True])
    rows = [(d, s, n, c, t) for d, t, crcs in zip(group.doc_id, group.doc_tokens, group.crcs, strict=True) for (s, n), c in zip(pieces_of(t), crcs, strict=True)]
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    out["doc_id"] = out.doc_id.astype("Int64")
    full = out.length.values == CAPACITY
    sequence, offset = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    sequence[~full], offset[~full] = pack(out.length.values[~full])
    packed = int(sequence[~full].max()) + 1 if (~full).any() else 0
    sequence[full] = packed + np.arange(full.sum())
    out["sequence_id"], out["offset"] = (int(group.group.iloc[0]) << 32) + sequence, offset
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece of each row of docs.

    A null or empty text is one piece of the end id. Repeated rows are packed each; ids may be null. Other columns are not
    read. An empty table gives an empty one. Sequence numbers have gaps. Documents are dealt to groups by their id, their
    tokens and their place in the partition that they are read in, so that rows repeated many times spread over all groups.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _WORKER.setdefault(tokenizer, TokenIds(tokenizer)) if tokenizer not in _WORKER else _WORKER[tokenizer]
        seen = 0
        for b in slices(batches):
            nth, seen = pa.array(range(seen, seen + b.num_rows), pa.int64()), seen + b.num_rows
            sizes, crcs, keys = [], [], []
            for data in ids.of_all(b.column("text")):
                sizes.append(len(data) // 4)
                crcs.append([zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in pieces_of(sizes[-1])])
                keys.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), nth], names=["doc_id", "doc_tokens", "key", "crcs", "nth"])

    groups = max(1, -(-docs.count() // GROUP_ROWS))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = own.mapInArrow(tokenize, "doc_id long, doc_tokens long, key long, crcs array<long>, nth long")
    counted = counted.withColumn("group", F.pmod(F.xxhash64("doc_id", "key", "nth"), F.lit(groups)))
    return counted.groupBy("group").applyInPandas(_pack_group, PACKED)
