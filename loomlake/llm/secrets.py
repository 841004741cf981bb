"""Secrets in texts: patterns of known formats, and guess costs of values in a credential's context.

A value after a word such as `password` is segmented by dynamic programming into words, dates, repeats, keyboard walks
and brute-force spans so that the guesses of all segments are fewest; a value that still takes at least MIN_GUESSES is a
secret, while `password: changeme` is not. Words are those of passwords and placeholders, and then the frequent words of the
corpus, in whatever languages it has, as far as they stand outside of values and after several different words.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import slices

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value is a secret.
MIN_GUESSES = 8.0
#: Characters of a value at least.
MIN_VALUE = 6
#: Words of the corpus in the dictionary at most (all workers have it), and their letters.
CORPUS_WORDS, LETTERS = 30_000, (3, 24)
#: Words of the corpus stand after so many different words at least; copies of a text add none.
MIN_BEFORE = 5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{32,}", re.ASCII)
_WORD = re.compile(r"(?:password|passwd|pwd|passphrase|passcode|secret|token|credential|api[_-]?key|auth[_-]?key|private[_-]?key)s?", re.ASCII | re.IGNORECASE)
#: The rest of a name, as in password_hash, and what may stand between a name and its value.
_NAME = re.compile(r"[A-Za-z0-9_-]*", re.ASCII)
_SEP = re.compile(r"""(?:\\?["'`])?(?:[\x20\t]+(?:is|was))?[\x20\t]*[:=][\x20\t]*(\\?["'`])?""", re.ASCII | re.IGNORECASE)
_IS = re.compile(r"""["']?[\x20\t]+(?:is|was)[\x20\t]+(\\?["'`])?""", re.ASCII | re.IGNORECASE)
_GAP = re.compile(r"""["']?[\x20\t]*(\\?["'`])?""", re.ASCII)
#: A value by the quote before it: up to that quote, or else up to any quote, a semicolon, or a comma or & before the next name.
_VALUES = {
    None: re.compile(r"(?:[!#-%(-+\--:<-_a-~]|[,&](?![A-Za-z0-9_-]+[:=]))*", re.ASCII),
    '"': re.compile(r"[!#-~]*", re.ASCII),
    "'": re.compile(r"[!-&(-~]*", re.ASCII),
    "`": re.compile(r"[!-_a-~]*", re.ASCII),
    "\\": re.compile(r"""(?:[!#-&(-\[\]-_a-~]|\\(?!["'`]))*""", re.ASCII),
}
#: Both for Java, in lower case: a credential word with what follows up to its value, and a value after the mark of such words.
_CONTEXT = r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|auth|private)[_-]?key)[a-z0-9_-]*+["'`\\]*+(?:\s+(?:is|was)(?=\s))?[\s:="'`\\]*+"""
_MARKED = "\x01++[^\\s\x01]*+"
#: No match of a context or an assignment without one of these.
_HINT = re.compile(r"pass|pwd|secret|token|cred|key", re.ASCII | re.IGNORECASE)
_DATES = tuple(
    re.compile(p, re.ASCII)
    for p in (r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", r"(?:19|20)\d\d")
)

# Frequent words of passwords and placeholders, most frequent first, and rows of the keyboard.
WORDS = (
    "password pass admin root user login welcome letmein master monkey dragon secret qwerty abc test guest default changeme change your my the and "
    "example sample placeholder dummy none null true false required optional value string here token key api auth client server database local host "
    "love baby angel princess sunshine shadow hello freedom whatever football baseball soccer hockey batman superman summer winter spring autumn "
    "monday friday january march april june july august september october november december correct horse battery staple blue red green black white "
    "computer internet google home house family money happy lucky star moon sun cat dog tiger lion eagle michael john david daniel thomas robert "
    "james maria anna mary peter paul alex chris new old one two three four five six seven eight nine ten zero not this that with for you is was are"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_LEET = str.maketrans("4@301!5$7", "aaeoiisst")
_NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
#: Widths of blocks that may be said again.
BLOCKS = (2, 3, 4, 5, 6, 8)


class Dictionary:
    """Words and the log10 of their guesses, which follow from their rank: WORDS come first, then others as given."""

    def __init__(self, others: list[str] = ()):
        self.cost: dict[str, float] = {}
        for w in [*WORDS, *others]:
            self.cost.setdefault(w, math.log10(len(self.cost) + 2))
        self.longest = max(map(len, self.cost))


DICTIONARY = Dictionary()


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


class _Starts:
    """Starts of a run (a walk or a repeat) that may still be the best: cost of a span = best at its start + log10 of its length.

    A start that is no better than an earlier and cheaper one never gets better again, since the lengths draw nearer to
    each other; one that a later and cheaper start has caught up with is behind for good. So few starts are kept, and none
    that is left out could be best.
    """

    def __init__(self):
        self.live: list[tuple[int, float]] = []

    def add(self, start: int, best: float) -> None:
        while self.live and self.live[-1][1] >= best:
            self.live.pop()
        self.live.append((start, best))

    def least(self, end: int) -> float:
        costs = [b + math.log10(end - s) for s, b in self.live]
        kept, low = [], math.inf
        for x, c in zip(self.live, costs):
            if c < low:
                kept.append(x)
                low = c
        self.live = kept
        return low


def guess_cost(value: str, enough: float = math.inf, words: Dictionary = DICTIONARY) -> float:
    """log10 of the guesses of the cheapest segmentation of value; `enough` where all segmentations take that many."""
    low, n = value.lower(), len(value)
    if len(low) != n:  # a letter whose lower case has several code points
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    ends: dict[int, list[int]] = {}
    for pattern in _DATES:
        for i in range(n):
            if m := pattern.match(low, i):
                ends.setdefault(i, []).append(m.end())
    walks, repeats = _Starts(), _Starts()
    walk = rep = 0  # where the longest walk and repeat that hold character j began
    for j in range(n):
        if j and (low[j - 1], low[j]) not in _NEXT:
            walk, walks = j, _Starts()
        if j and low[j] != low[j - 1]:
            rep, repeats = j, _Starts()
        own = best[j] + _brute(low[j]) + (0.3 if value[j].isupper() else 0.0)
        for i in range(max(0, j - words.longest + 1), j - 1):
            cost = words.cost.get(low[i : j + 1])
            if cost is None and (cost := words.cost.get(plain[i : j + 1])) is not None:
                cost += 0.5
            if cost is not None:
                own = min(own, best[i] + cost + (0.3 if value[i : j + 1] != low[i : j + 1] else 0.0) + 0.3)
        # walks and repeats have three characters at least
        if j - walk >= 2:
            walks.add(j - 2, best[j - 2])
            own = min(own, walks.least(j + 1) + math.log10(47 * 2))
        if j - rep >= 2:
            repeats.add(j - 2, best[j - 2])
            own = min(own, repeats.least(j + 1) + _brute(low[j]))
        for w in BLOCKS:  # a block said again, as in abcabc
            if j + 1 >= 2 * w and low[j + 1 - w : j + 1] == low[j + 1 - 2 * w : j + 1 - w]:
                own = min(own, best[j + 1 - w] + 0.3)
        best[j + 1] = min(best[j + 1], own)
        for e in ends.get(j, ()):
            best[e] = min(best[e], best[j] + (2.1 if e - j == 4 else 4.6))
        # every segmentation goes on from one of these places
        if j % 32 == 31:
            near = best[max(0, j + 1 - words.longest) : j + 12]
            if min(b for b in [*near, *[b for _, b in walks.live], *[b for _, b in repeats.live]] if b < math.inf) >= enough:
                return enough
    return best[n]


def find_secrets(text: str | None, words: Dictionary = DICTIONARY) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a text in code points, end exclusive, by start and then by kind."""
    text = text or ""
    found = [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)] + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if _HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(s, e, "guess") for s, e in _guesses(text, sorted(x[:2] for x in found), words)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


class _Runs:
    """Ends of the runs of a pattern's characters; a run that holds many starts is read once."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.start, self.stop = pattern, text, 0, -1

    def end(self, at: int) -> int:
        if not self.start <= at < self.stop:
            self.start, self.stop = at, self.pattern.match(self.text, at).end()
        return self.stop


def _guesses(text: str, base: list[tuple[int, int]], words: Dictionary) -> list[tuple[int, int]]:
    """Spans of values after credential words, outside the spans of base (sorted) and of each other.

    Every word is looked at, also one that stands where the value of another is sought. After a separator all values
    count; without one, a value must not look like prose. A value holds no white space and has MIN_VALUE characters.
    """
    starts, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max))
    names, values = _Runs(_NAME, text), {quote: _Runs(pattern, text) for quote, pattern in _VALUES.items()}
    out: list[tuple[int, int]] = []
    dull = -1  # end of a run that holds no value of two classes any more

    def add(s: int, e: int, parted: bool, quoted: bool = False) -> None:
        nonlocal dull
        i = bisect.bisect_left(starts, e)
        if e - s < MIN_VALUE or i and reach[i - 1] > s or out and out[-1][1] > s:
            return
        if not parted:
            if e == dull:
                return
            if not _is_value(text[s:e]):
                dull = e
                return
        if not quoted:
            e -= e - s - len(text[s:e].rstrip(".,;:!?)\"'"))
        if e - s >= MIN_VALUE and (parted or _is_value(text[s:e])) and guess_cost(text[s:e], MIN_GUESSES, words) >= MIN_GUESSES:
            out.append((s, e))

    def follow(before: re.Match, parted: bool) -> None:
        """The value that follows a match whose group is the quote that opens it, if any."""
        quote = before[1] and before[1][0]
        end = values[quote].end(before.end())
        add(before.end(), end, parted, bool(quote) and text.startswith(before[1], end))

    def parted(at: int) -> re.Match | None:
        """What parts a name that may go on here from its value."""
        return _SEP.match(text, names.end(at))

    for m in _WORD.finditer(text):
        at = m.end()
        name = names.end(at)
        if sep := parted(at):
            if any(c.isdigit() for c in text[at:name]):
                add(at, name, False)
            follow(sep, True)
        elif said := _IS.match(text, name):
            follow(said, False)
        else:
            gap = _GAP.match(text, at)
            following = _WORD.match(text, gap.end())
            if not (following and parted(following.end())):
                follow(gap, False)
    return out


def _is_value(value: str) -> bool:
    """Prose after a credential word ("passwords should") is no value: it takes two classes of characters."""
    return sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value[1:]), any(not c.isalnum() for c in value))) >= 2


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> Dictionary:
    """The dictionary of a corpus: its `most` most frequent words, counted over all whole texts, ties by the word.

    What follows a credential word is not counted, and a word must stand after MIN_BEFORE different words (told apart by 6
    bits of hash), so that neither a secret that is repeated nor copies of a text make a word. Nulls and empty texts have
    none. No more than `most` rows reach the driver.
    """
    low = F.lower(F.col(text_col).cast("string"))
    outside = F.when(low.rlike(_HINT.pattern), F.regexp_replace(F.regexp_replace(low, _CONTEXT, "\x01"), _MARKED, " ; ")).otherwise(low)
    lists = docs.select(F.regexp_extract_all(outside, F.lit(r"\p{L}+"), F.lit(0)).alias("words")).where(F.size("words") > 0)
    pairs = lists.select(F.explode(F.arrays_zip("words", F.concat(F.array(F.lit("")), F.slice("words", F.lit(1), F.size("words") - 1)).alias("before"))).alias("x"))
    before = F.expr("shiftleft(1L, cast(pmod(xxhash64(x.before), 64L) AS int))")
    counts = pairs.select(F.col("x.words").alias("word"), before.alias("before")).where(F.length("word").between(*LETTERS))
    counts = counts.groupBy("word").agg(F.count("*").alias("n"), F.bit_or("before").alias("before")).where(F.bit_count("before") >= MIN_BEFORE)
    return Dictionary([r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).select("word").collect()])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Dictionary | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess), a row for each row of docs.

    words: the dictionary of guesses, by default that of docs. A null or empty text has no spans; its base_sha256 is that
    of the empty string. Repeated rows each have their row, a null id stays. Spans of different kinds may overlap; `guess`
    spans lie outside all others. An empty table gives an empty one. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words or corpus_words(docs, text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")}
            for text in b.column("text"):
                spans = find_secrets(text.as_py(), sent.value)
                base = [x for x in spans if x[2] != "guess"]
                for kind in KINDS:
                    rows[f"n_{kind}"].append(sum(x[2] == kind for x in spans))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
            kinds = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]], names=["doc_id", *rows])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>", words: Dictionary | None = None) -> DataFrame:
    """docs with every secret of the text replaced by a mark.

    words: as in `secret_spans`. Null and empty texts stay, all rows and columns stay, also repeated ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words or corpus_words(docs, text_col))

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            out = []
            for text in texts.to_pylist():
                spans = find_secrets(text, sent.value)
                at, parts = 0, []
                for s, e, _ in spans:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if spans else text)
            yield pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(clean, "string")(F.col(text_col)))
