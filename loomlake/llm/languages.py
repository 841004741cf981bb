"""Language identification: script ranges narrow the candidates, and Viterbi labels the words of mixed texts.

Each language has log-probabilities of hashed character trigrams, and the scripts that its training texts are written in.
A word's score in a language is the mean of its trigrams, times the root of their number; languages that don't use the
word's script are out. The best sequence of languages pays SWITCH at each change, which gives spans; a text's language is
that of most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import bounded_sample, slices, split_of

#: Texts from which the trigrams are counted, chosen by a hash of the row.
TRAIN_ROWS = 20_000
SLOTS = 1 << 16
SWITCH = 12.0
#: A language uses a script if so many of its letters are of it.
SCRIPT_SHARE = 0.02
OUT = -50.0
#: Characters of a text that are scored at once; whole texts are, piece by piece.
PIECE = 1 << 20

# First code points of ranges of letters, and the script of each (0: no letters).
RANGES = [
    (0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0),
    (0xF8, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 7), (0x780, 6), (0x7C0, 7), (0x900, 8), (0x980, 9), (0xA00, 10),
    (0xA80, 11), (0xB00, 12), (0xB80, 13), (0xC00, 14), (0xC80, 15), (0xD00, 16), (0xD80, 17), (0xE00, 18), (0xE80, 19), (0xF00, 20), (0x1000, 21), (0x10A0, 22),
    (0x1100, 23), (0x1200, 24), (0x1400, 7), (0x1780, 25), (0x1800, 26), (0x18B0, 7), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 7), (0x2E00, 0), (0x3005, 27),
    (0x3008, 0), (0x3040, 28), (0x3100, 27), (0x3130, 23), (0x3190, 0), (0x3400, 27), (0xA000, 7), (0xAC00, 23), (0xD800, 0), (0xF900, 27), (0xFB00, 1), (0xFB1D, 5),
    (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFEFF, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 28), (0xFFA0, 23), (0xFFE0, 0), (0x10000, 7),
    (0x1F000, 0), (0x20000, 27), (0x30000, 0),
]
N_SCRIPTS = 29

_STARTS = np.array([a for a, _ in RANGES], np.uint32)
_SCRIPTS = np.array([b for _, b in RANGES], np.uint8)
_LOW = _SCRIPTS[np.searchsorted(_STARTS, np.arange(0x3000), "right") - 1]


def scripts_of(codes: np.ndarray) -> np.ndarray:
    if not len(codes) or codes.max() < len(_LOW):
        return _LOW[codes]
    return _SCRIPTS[np.searchsorted(_STARTS, codes, "right") - 1]


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters of a text, lower-cased: trigram slots, scripts, and the place of each word's first letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    scripts = scripts_of(codes)
    is_letter = scripts > 0
    plain = np.where(is_letter, codes, 32).astype(np.uint32)
    before, after = np.r_[np.uint32(32), plain[:-1]], np.r_[plain[1:], np.uint32(32)]
    at = np.flatnonzero(is_letter)
    h = before[at] * np.uint32(0x9E3779B1) ^ plain[at] * np.uint32(0x85EBCA77) ^ after[at] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    slots = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    starts = np.flatnonzero(np.r_[True, np.diff(at) > 1])[: len(at)]
    return slots, scripts[at], starts


class Languages:
    """Names, log-probabilities (SLOTS, languages) and allowed scripts (N_SCRIPTS, languages)."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        p = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * SLOTS) if names else counts
        self.logs = np.log(p).astype(np.float32)
        self.fits = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        #: the language of most training letters, for texts whose letters tell nothing; ties in order of the name
        self.usual = int(scripts.sum(axis=0).argmax()) if names else 0
        self.fits[:, :] |= ~self.fits.any(axis=1)[:, None]  # a script that no language uses tells nothing

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words, languages) and letters of each word."""
        slots, scripts, starts = words_of(text)
        if not len(starts):
            return np.zeros((0, len(self.names)), np.float32), starts
        sums = np.add.reduceat(self.logs[slots], starts, axis=0)
        letters = np.diff(np.r_[starts, len(slots)])
        scores = sums / np.sqrt(letters)[:, None]
        return scores + np.where(self.fits[scripts[starts]], 0, OUT), letters

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word: scores less SWITCH for each change of language."""
        n = len(scores)
        if not n:
            return np.zeros(0, np.int64)
        # one language throughout is best if no run of words gains more than a change costs
        one = int(scores.sum(axis=0).argmax())
        gain = np.cumsum(scores - scores[:, one : one + 1], axis=0, dtype=np.float64)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
        if (gain - low).max() <= SWITCH:
            return np.full(n, one)
        back = np.empty(scores.shape, np.int32)
        best = scores[0].astype(np.float64)
        stay = np.arange(scores.shape[1])
        for t in range(n):
            if t:
                top = int(best.argmax())
                change = best[top] - SWITCH
                back[t] = np.where(best >= change, stay, top)
                best = np.maximum(best, change) + scores[t]
        out = np.empty(n, np.int64)
        out[-1] = int(best.argmax())
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of the spans of a text."""
        path = self.path(self.word_scores(text)[0])
        cuts = np.flatnonzero(np.r_[True, np.diff(path) != 0, True]) if len(path) else []
        return [(int(a), int(b), self.names[path[a]]) for a, b in zip(cuts, cuts[1:])]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most letters and its share of them; und and 0 without a letter or a learned language.

        Of languages with equal shares the first by name is taken. Where no letter lies in a known range, it is the usual
        language, with the score of a guess.
        """
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0
        share = np.zeros(len(self.names))
        for i in range(0, len(text), PIECE):
            scores, letters = self.word_scores(text[i : i + PIECE])
            np.add.at(share, self.path(scores), letters)
        if not share.any():
            return self.names[self.usual], 1 / len(self.names)
        return self.names[int(share.argmax())], float(share.max() / share.sum())


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Languages:
    """Languages of docs, whose texts and languages are taken as they are, from at most about TRAIN_ROWS rows of them.

    Rows are chosen by a hash of id and text, and repeated ones count once. Rows without a text or a language teach nothing.
    """
    names = {"id": id_col, "text": text_col, "lang": lang_col}
    rows = docs.select(*[F.col(c).cast("string").alias(k) for k, c in names.items()]).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = bounded_sample(rows, TRAIN_ROWS, "id", "text").drop("id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                own = grams.setdefault(lang, np.zeros(SLOTS + N_SCRIPTS, np.int64))
                for i in range(0, len(text), PIECE):
                    slots, scripts, _ = words_of(text[i : i + PIECE])
                    own[:SLOTS] += np.bincount(slots, minlength=SLOTS)
                    own[SLOTS:] += np.bincount(scripts, minlength=N_SCRIPTS)
        for lang, own in grams.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], names=["lang", "slot", "n"])

    table = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((SLOTS + N_SCRIPTS, len(names)))
    counts[table.column("slot").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return Languages(names, counts[:SLOTS], counts[SLOTS:])


def identify(docs: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score of each text; `und` for a null, or for a text without a letter.

    Columns of docs that are named like one of the two give way to it. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            names, scores = [], []
            for text in texts.to_pylist():
                name, score = sent.value.predict(text)
                names.append(name)
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = F.arrow_udf(predict, "lang_pred string, score double")(F.col(text_col).cast("string")).alias("_found")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*own).alias("_row") if own else F.lit(None).alias("_row"), found)
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "_found.lang_pred", "_found.score")


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs.

    Languages are learned from rows whose crc32 of the id, mod 3, is not 1; rows without an id are neither learned from nor
    held out. Without anything to learn from, all is `und`. Repeated rows get the same row each. An empty table gives an
    empty one.
    """
    part = split_of("doc_id", 3)
    languages = learn(docs.where(part != 1))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(own, languages).drop("text")
