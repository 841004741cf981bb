import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomlake.llm import alignment

DOCS = "doc_id long, text string, lang string, row string, ids string, n_a string, pair string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "x", "x", "x") for i, t in rows], DOCS)


def plain_groups(text):
    """The groups of a text, by whole texts and sets of ends."""
    a_side, b_side = Tokenizer.from_file(alignment.BYTE_TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_TOKENIZER)
    a_side.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    if not text:
        return None
    a = [(t.id, bytes(byte[c] for c in t.value)) for t in map(lambda i: type("T", (), {"id": i, "value": a_side.id_to_token(i)}), a_side.encode(" " + text, add_special_tokens=False).ids)]
    b = [(i, bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()) for i in b_side.encode(text)]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return None
    ends = []
    for side in (a, b):
        at, own = 0, []
        for _, x in side:
            at += len(x)
            own.append(at)
        ends.append(own)
    groups, start = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append((start, end, *[[i for (i, _), e in zip(side, own, strict=True) if start < e <= end] for side, own in zip((a, b), ends, strict=True)]))
        start = end
    return groups


def plain(rows):
    every = [plain_groups(t) for _, t in rows]
    linked = [Counter((x, y) for _, _, a, b in g or [] for x in a for y in b) for g in every]
    count = Counter(p for own in linked for p in own)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), g, own in zip(rows, every, linked, strict=True):
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in g)
        n_best = sum(n for p, n in own.items() if count[p] == best[p[0]])
        out.append((i, sum(len(a) for _, _, a, _ in g), sum(len(b) for _, _, _, b in g), len(g), sum(own.values()), n_best, sum(n * count[p] for p, n in own.items()), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(map(repr, out))


rng = np.random.default_rng(1)
LETTERS = [*"aeinrst  \n\t.,'é中　▁", "<|endoftext|>", "<s>", "<0x41>", " the", " of", "  ", "Straße", "🙂"]
ODD = [(1, None), (2, ""), (None, "no id"), (None, None), (3, " leading and  double   spaces "), (4, "same text"), (4, "same text"), (4, "other text"), (5, "▁"), (6, "<|endoftext|> <s>"), (7, "\n\n"), (8, "a" * 3000)]
FUZZ = [(100 + k, "".join(rng.choice(LETTERS, int(rng.integers(1, 60))))) for k in range(120)]


@pytest.mark.parametrize("hot, block, segment", [(1 << 20, 8192, 1 << 20), (20, 3, 40), (0.5, 1, 1)])
def test_alignment_against_plain_sets(spark, monkeypatch, hot, block, segment):
    for name, value in (("HOT_PAIRS", hot), ("BLOCK", block), ("SEGMENT", segment)):
        monkeypatch.setattr(alignment, name, value)
    rows = ODD + FUZZ
    got = alignment.align_tokens(frame(spark, rows).repartition(3))
    assert got.columns == COLUMNS
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokens(frame(spark, [])).collect() == []
    assert alignment.align_tokens(frame(spark, [(1, None)])).collect()[0].groups_sha256 == ""


def test_groups_carry_ids_and_places(spark):
    text = "Straße 中 of the\n" * 50
    got = alignment.token_groups(frame(spark, [(1, text), (2, None)])).orderBy("start").collect()
    assert [(r.start, r.end, list(r.a_ids), list(r.b_ids)) for r in got] == plain_groups(text)


def test_long_text_is_cut_where_words_are_apart():
    text = b" " + b"word and other words \xc2\xa0  odd\n " * 20000
    parts = list(alignment._parts(text))
    assert len(parts) == 1 or b"".join(parts) == text
    side = alignment.ByteSide()
    whole = side.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert np.concatenate([ids for _, ids, _ in side.blocks(text)]).tolist() == whole


def test_ids_by_rank_are_those_of_the_tokenizer():
    side = alignment.ByteSide()
    assert side.fast
    for _, text in FUZZ:
        assert side.ids(text.encode()).tolist() == side.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block, segment", [(1, 1), (3, 40), (7, 1 << 20)])
def test_machine_over_small_blocks(monkeypatch, block, segment):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    sides = alignment.ByteSide(), alignment.PieceSide()
    for _, text in FUZZ:
        want = plain_groups(text)
        events = sorted((at, k, ids.tolist(), ok) for k, side in enumerate(sides) for at, ids, ok in side.blocks(b" " + text.encode()))
        if not all(ok for *_, ok in events):
            assert want is None
            continue
        machine, told = alignment._Sweep(tuple(s.sizes for s in sides)), b""
        for at, k, ids, _ in events:
            if closed := machine.take(k, at, np.array(ids, np.uint16)):
                told += alignment.groups_text(*closed[:4])
        assert told.decode() == "".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for _, _, a, b in want)
