"""Each method against its plain form: all cases, or all pairs, of small inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.llm import common, decontaminate, languages, near_dedup, packing, quality, secrets, substrings, urls
from loomlake.llm.sharding import hilbert_shards, write_shards

SF = "/root/testdata/sf0.001"


def test_samples_are_bounded_whatever_is_hot(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") < 39_000, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.lit("x").alias("t"))
    got = common.bounded_sample(rows, 500, "id", "t").collect()
    assert 350 <= len(got) <= 500 and len({r.id for r in got}) == len(got)
    assert common.bounded_sample(rows.limit(0), 500, "id").count() == 0


def test_likely_rows_hold_all_wanted_ones(spark):
    rows = spark.range(-5000, 5000).union(spark.createDataFrame([(None,)], "id long"))
    wanted = spark.range(-100, 100).withColumnRenamed("id", "w")
    got = {r.id for r in common.likely(rows, "id", wanted).collect()}
    assert set(range(-100, 100)) <= got and None not in got and len(got) < 1500
    assert common.likely(rows, "id", wanted.limit(0)).count() == 0
    assert common.likely(rows, "id", spark.range(10_000).toDF("w"), most_bits=1 << 10).count() == 10_001


def test_slices_hold_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c" * 3], "k": range(5)})
    parts = list(common.slices([b], most=12))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2], [3, 4]]
    assert [len(x) for x, _ in common.slices([(b.column("text"), b.column("k"))], 0, most=1000)] == [5]


def test_longest_matches_with_both_places(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(6)]
    texts = {i: [rng.choice(vocab) for _ in range(rng.randint(0, 60))] for i in range(60)}
    items = {i: [rng.choice(vocab) for _ in range(rng.randint(0, 14))] for i in range(25)}
    for k in range(0, 60, 3):  # two items after each other, and one within other words
        texts[k] += items[k % 25] + items[(k + 1) % 25] + ["x"] + items[k % 25][3:]
    want = set()
    for d, t in texts.items():
        for i, x in items.items():
            k = min(decontaminate.WINDOW, len(x))
            for p in range(len(t)):
                for q in range(len(x)):
                    if p and q and t[p - 1] == x[q - 1]:
                        continue
                    n = 0
                    while p + n < len(t) and q + n < len(x) and t[p + n] == x[q + n]:
                        n += 1
                    if k and n >= k:
                        want.add((d, str(i), q, p, n))
    docs = spark.createDataFrame([(i, " ".join(t), "mine", 7) for i, t in texts.items()], "doc_id long, text string, n_words string, hits long")
    bench = spark.createDataFrame([(i, "; ".join(x).upper()) for i, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, m["item"], m["item_at"], m["at"], m["length"]) for r in decontaminate.contamination(docs, bench).collect() for m in r.matches}
    assert got == want and len(want) > 50
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {(r.doc_id, r.n_words, r.hits) for r in left.collect()} == {(i, "mine", 7) for i in texts if i not in {d for d, *_ in want}}


def test_blocks_are_counted_in_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    bench = spark.createDataFrame([(i, "\n".join(f"w{i}x{k}" for k in range(20))) for i in range(10)], "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, "item_id", "text"))
    assert len(blocks) >= 4 and sorted(i for b in blocks for i in b.items) == sorted(map(str, range(10)))


def test_token_ids_of_odd_strings():
    from tokenizers import Tokenizer

    plain, mine, rng = Tokenizer.from_file(packing.TOKENIZER), packing.TokenIds(), random.Random(3)
    parts = list("abcXYZ019 \t\n\r\x0b\x0c\x1c\x1f\x00\x85\xa0'’.,;-ßÿİıǅﬁΣςéñạ̊́̈\u200d\u2003一한ا½²ⅷ🙂") + ["<|endoftext|>", "<|startoftext|>", "<|endof", "'s", "'re", "é,", "İ,"]
    assert mine.by_word
    for _ in range(100_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(mine.of(s.encode()), "<u4").tolist() == [*plain.encode(s, add_special_tokens=False).ids, packing.END_ID], s
    # a tokenizer of another kind gets whole texts
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = packing.TokenIds(path)
    assert not other.by_word and np.frombuffer(other.of("Hello  World".encode()), "<u4").tolist()[:-1] == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


def test_plain_words_are_cut_without_the_whole_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    plain, mine, rng, asked = Tokenizer.from_file(packing.TOKENIZER), packing.TokenIds(), random.Random(4), []
    whole = mine._whole
    monkeypatch.setattr(mine, "_whole", lambda text: asked.append(text) or whole(text))
    words = ["the", "The", "THE!!", "für", "FÜR,", "ção...", "the&&&", "don't", "'tis", "''s", "BY-NC", "4.0.", "a1b22", "x@y.z", "<|ENDOFTEXT|>", "ßÿÞ'RE", "\\|[]{}^_`~", "|"]
    for _ in range(300):
        s = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r", ""]) for _ in range(20))
        assert np.frombuffer(mine.of(s.encode()), "<u4").tolist() == [*plain.encode(s, add_special_tokens=False).ids, packing.END_ID], s
    assert asked == []


def test_token_ids_of_a_batch(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(packing.TOKENIZER), packing.TokenIds()
    texts = ["first", None, "", " \n ", "T\u0308 t\u0308 K\u212a", "a<|endoftext|>B", " für  Für, don't", "\u2019s a\u2003b 1\u00bd2", "first first"]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
    for batch, expected in [(pa.array(texts), want), (pa.array(texts).slice(3, 5), want[3:8]), (pa.array(texts, pa.large_string())[:0], [])]:
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.of_all(batch)] == expected
    # a long text is taken in segments
    monkeypatch.setattr(common, "SEGMENT_BYTES", 16)
    text = " ".join(f"{t or ''} Größe{k}, {'x' * k}" for k, t in enumerate(texts * 4))
    assert np.frombuffer(mine.of(text.encode()), "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID]


def all_segmentations(v, words=secrets.DICTIONARY):
    low, n = v.lower(), len(v)
    plain = low.translate(secrets._LEET)

    def span(i, e):
        costs = [secrets._brute(low[i]) + (0.3 if v[i].isupper() else 0)] if e - i == 1 else []
        if e - i >= 3:
            exact = low[i:e] in words.cost
            if exact or plain[i:e] in words.cost:
                costs.append((words.cost[low[i:e]] if exact else words.cost[plain[i:e]] + 0.5) + 0.3 + (0.3 if v[i:e] != low[i:e] else 0))
            if all((low[k], low[k + 1]) in secrets._NEXT for k in range(i, e - 1)):
                costs.append(math.log10(94 * (e - i)))
            if len(set(low[i:e])) == 1:
                costs.append(secrets._brute(low[i]) + math.log10(e - i))
        costs += [2.1 if e - i == 4 else 4.6 for p in secrets._DATES if p.fullmatch(low, i, e)]
        if e - i in secrets.BLOCKS and 2 * i - e >= 0 and low[i:e] == low[2 * i - e : i]:
            costs.append(0.3)
        return min(costs, default=math.inf)

    best = [0.0] + [math.inf] * n
    for e in range(1, n + 1):
        best[e] = min(best[i] + span(i, e) for i in range(e))
    return best[n]


def test_guess_costs_are_least():
    rng = random.Random(1)
    for _ in range(4000):
        v = "".join(rng.choice("qwertasdcatpassword1aaa2024-01Q4@0") for _ in range(rng.randint(0, 14)))
        for more in ("aaaaaaaaaa", "qwertyuiop", "20240131", "password"):
            if rng.random() < 0.25:
                at = rng.randint(0, len(v))
                v = v[:at] + more[rng.randint(0, 5) :] + v[at:]
        cost = secrets.guess_cost(v)
        assert abs(cost - all_segmentations(v)) < 1e-9, v
        assert secrets.guess_cost(v, 5.0) >= min(5.0, cost) - 1e-9 and (cost >= 5.0) == (secrets.guess_cost(v, 5.0) >= 5.0), v
    whole = "a9" * 31 + "password"  # nothing is cut into pieces
    assert secrets.guess_cost(whole) < secrets.MIN_GUESSES and abs(secrets.guess_cost("catrewq") - 4.8708) < 1e-3


def test_words_of_the_corpus_are_no_secrets(spark):
    texts = [f"Der {x} Sonnenschein {x} über strawberry" for x in "rote warme helle neue alte letzte erste".split()]
    docs = spark.createDataFrame([*enumerate(texts), (7, "seltenwort"), (8, None), (9, "")], "doc_id long, text string")
    words = secrets.corpus_words(docs)
    assert "sonnenschein" in words.cost and "über" in words.cost and "seltenwort" not in words.cost
    find = lambda t, w: [t[s:e] for s, e, k in secrets.find_secrets(t, w) if k == "guess"]
    assert find("pwd: Sonnenschein1", words) == [] and find("pwd: Sonnenschein1", secrets.DICTIONARY) and find("pwd: kXw9vTq2Lmz", words)
    assert secrets.redact(docs.limit(0)).count() == 0 and secrets.secret_spans(docs.limit(0)).count() == 0


def guessed(text, words=secrets.DICTIONARY):
    return [text[s:e] for s, e, k in secrets.find_secrets(text, words) if k == "guess"]


def test_secrets_that_repeat_are_no_words(spark):
    near = [f"Config of host{chr(97 + i)} pwd: qzvkxwjhpfgm done" for i in range(12)] + [f"{x} secret password = qzvkxwjhpfgm" for x in "one two three four five six seven".split()]
    copies = ["log in with vbqhtkzrwy and go"] * 40 + [f"log in with vbqhtkzrwy and go {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate([*near, *copies, "password password is " * 20_000, "password" * 20_000])), "doc_id long, text string")
    words = secrets.corpus_words(docs)
    assert not {"qzvkxwjhpfgm", "vbqhtkzrwy"} & set(words.cost)
    got = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    assert all(got[i].n_guess + got[i].n_assign == 1 for i in range(len(near))) and guessed("pwd: vbqhtkzrwy", words) == ["vbqhtkzrwy"]
    assert secrets.corpus_words(docs, most=1).cost.keys() - secrets.DICTIONARY.cost.keys() <= words.cost.keys()
    assert secrets.corpus_words(docs.limit(0)).cost == secrets.DICTIONARY.cost


def test_values_end_where_they_are_closed():
    cases = {
        '{"password":"Xk9#mP2q!z","user":"bob","email":"x@y.z"}': ["Xk9#mP2q!z"],
        '{"pwd":"cat","user":"bartholomew","email":"x@y.z"}': [],
        "pwd: Xk9#mP2q;name=bartholomew": ["Xk9#mP2q"],
        "pwd=Xk9#mP,2q,user=bartholomew": ["Xk9#mP,2q"],
        "u?pwd=Xk9#mP&2q&user=bartholomew": ["Xk9#mP&2q"],
        "{'pwd': 'Xk9\"mP;2q!'}": ['Xk9"mP;2q!'],
        '{\\"pwd\\":\\"Xk9#mP2q\\",\\"user\\":\\"bob\\"}': ["Xk9#mP2q"],
        "the passphrase is `Xk9#m'P2q`.": ["Xk9#m'P2q"],
        'pwd: "Xk9#m P2q"': [],  # no white space in values, and six characters
        'pwd: "Xk9#mP2q': ["Xk9#mP2q"],
        '"pwd","username","email"': [],
    }
    for text, want in cases.items():
        assert guessed(text) == want, text
    assert guessed("pwd: " + "Xk9,mP;" * 50_000) == ["Xk9,mP"] and len(guessed('pwd: "' + ",a=" * 50_000)) == 1


def test_planted_secrets_are_found():
    rng = random.Random(9)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#!@%^*+~?"
    strong = lambda: "".join(rng.choice(chars) for _ in range(rng.randint(9, 16))) + "q7"
    phrase = lambda: "-".join(rng.sample(secrets.WORDS, 6))
    weak = lambda: rng.choice([rng.choice("changeme letmein password example dummy optional".split()) + rng.choice(["", "1", "12", "!"]), "qwertyuiop", "aaaaaaaaaa", "20240131", "abcabcabc"])
    frames = ['{{"pwd":"{}","user":"bartholomew"}}', "the passphrase is {} and more", "export DB_PASSCODE='{}'", "pwd: {}\nnext line", "credential = `{}`;", "user=bob;pwd={};name=christopher"]
    prose = ["passwords should be kept", "the secret garden is beautiful", "a token of appreciation", "credentials were issued yesterday", "she told the secret, then left"]
    found = false = 0
    for i in range(500):
        planted = i < 300
        if planted:
            value = strong() if i % 3 else phrase()
            found += guessed(frames[i % 6].format(value)) == [value]
        else:
            false += guessed(frames[i % 6].format(weak()) if i % 2 else prose[i % 5]) != []
    assert found >= 0.95 * 300 and false <= 2


def test_letters_and_ties_of_languages(spark):
    docs = spark.createDataFrame([(i, t, x, "mine", "mine") for i, (t, x) in enumerate([("der hund und die katze " * 20, "de"), ("the dog and the cat " * 30, "en")])], "doc_id long, text string, lang string, score string, lang_pred string")
    model = languages.learn(docs)
    for none in ("½ 12", "① ⅷ ²", "", None, "_-_"):
        assert model.predict(none) == ("und", 0.0)
    assert model.predict("ʰ") == ("en", 0.5)  # the usual language, as a guess
    got = languages.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {(r.lang, r.lang_pred) for r in got.collect()} == {("de", "de"), ("en", "en")}


def test_equal_texts_lie_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 10_000, "source": F.lit("https://other"), "lang": F.lit(None).cast("string")}))
    got = hilbert_shards(more, 5).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32, r.size].add(r.shard)
    counts = Counter(r.shard for r in got)
    # a shard's end may cut the group that it falls into
    assert len(got) == 400 and max(counts.values()) - min(counts.values()) <= 1 and sum(len(s) > 1 for s in shards.values()) <= 4


def test_shards_follow_the_metadata(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(i, f"text {i}", f"l{rng.integers(4)}", f"https://www.site{rng.integers(40):02d}.org", int(rng.integers(1000))) for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    write_shards(docs, str(tmp_path / "s"), 40)
    spread = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.countDistinct("lang").alias("l"), F.countDistinct("source").alias("s"), (F.max("n_chars") - F.min("n_chars")).alias("w"), F.count("*").alias("n")).collect()
    mean = lambda name: sum(r[name] for r in spread) / len(spread)
    # a reader that filters on one of them skips most files
    assert len(spread) == 40 and sum(r.n for r in spread) == 4000 and mean("l") <= 3.5 and mean("s") <= 20 and mean("w") <= 600


def test_hot_text_is_cut_only_by_the_ends_of_shards(spark):
    docs = spark.createDataFrame([(7, "same", "en", "s", 4)] * 3000 + [(i, f"t{i % 900}", "en", "s", 4) for i in range(3000)], "doc_id long, text string, lang string, source string, n_chars long")
    got = hilbert_shards(docs, 40).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert {r.n for r in got} == {150} and all(r.k == 150 and r.m == 149 for r in got)


def witten_bell(counts, context, c):
    """Chance of c after a context, from counts of (context, character) of all orders."""
    p = 1 / 256
    for k in range(urls.ORDER + 1):
        own = counts[k].get(context[len(context) - k :], Counter())
        n, t = sum(own.values()), len(own)
        p = (own[c] + t * p) / (n + t) if n else p
    return p


@pytest.mark.parametrize("limit", [urls.MODEL_GRAMS, 0])
def test_scores_of_urls_against_plain_counts(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "MODEL_GRAMS", limit)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(1000, "http://é.org/fr/ü"), (1001, None), (1002, "http://zz.de/q/12345"), (1002, "http://zz.de/q/12345")], "page_id long, url string"))
    host, path = urls.host_path("url")
    rule, verdict = urls.rule_of(host, path)
    known = pages.select("page_id", F.concat(host, path).alias("text"), verdict.alias("v")).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(urls.HELD)) == 0).collect()
    models = {}
    for v in ("allow", "block"):
        counts = [defaultdict(Counter) for _ in range(urls.ORDER + 1)]
        for r in known:
            if r.v == v and not r.held:
                c = "\x01" * urls.ORDER + urls._DIGITS.sub("0", r.text) + "\x02"
                data = c.encode()
                for i in range(urls.ORDER, len(data)):
                    for k in range(urls.ORDER + 1):
                        counts[k][data[i - k : i]][data[i]] += 1
        models[v] = counts
    got = defaultdict(set)
    for r in urls.filter_urls(pages).collect():
        got[r.page_id].add(r.score)
    for r in known:
        data = ("\x01" * urls.ORDER + urls._DIGITS.sub("0", r.text) + "\x02").encode()
        lp = [math.log(witten_bell(models["allow"], data[i - urls.ORDER : i], data[i])) - math.log(witten_bell(models["block"], data[i - urls.ORDER : i], data[i])) for i in range(urls.ORDER, len(data))]
        assert got[r.page_id] and all(abs(s - sum(lp) / len(lp)) < 1e-8 for s in got[r.page_id])
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_urls_without_a_rule_are_told_apart(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
    good, bad = (lambda: word("aeioulmnr")), (lambda: word("xzqkvwpjy"))
    data = [f"http://{good()}.org/fr/{good()}" for _ in range(400)] + [f"http://{bad()}.net/{bad()}" for _ in range(400)]
    asked = [(f"http://{good()}.info/fr/{good()}", "allow") for _ in range(100)] + [(f"http://{bad()}.info/{bad()}", "block") for _ in range(100)]
    pages = spark.createDataFrame(list(enumerate(data + [u for u, _ in asked])), "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    right = sum(got[len(data) + k].verdict == v and got[len(data) + k].rule is None for k, (_, v) in enumerate(asked))
    assert right >= 0.95 * len(asked)


def test_repeated_passages_against_all_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    owners = defaultdict(set)
    for r in docs.collect():
        w = r.text.split()
        for i in range(len(w) - 50):
            owners[tuple(w[i : i + 51])].add(r.doc_id)
    want = set().union(*[x for x in owners.values() if len(x) > 1])
    half = defaultdict(set)
    for r in docs.collect():
        w = r.text.split()
        for i in range(len(w) - 29):
            half[tuple(w[i : i + 30])].add(r.doc_id)
    near = set().union(*[x for x in half.values() if len(x) > 1])
    got = {r.doc_id for r in substrings.repeated_passages(docs).collect()}
    # all documents with such a passage, and none that share less than 30 words
    assert len(want) > 100 and len(want - got) <= 0.005 * len(want) and got <= near


def test_digests_that_repeat_are_found_by_brute_force(spark):
    docs = spark.createDataFrame([(-3, "neg " + " ".join(f"p{i}" for i in range(90))), (5, "pos " + " ".join(f"p{i}" for i in range(90))), (None, "none " + " ".join(f"p{i}" for i in range(90))), (6, "other " * 3), (8, "x " * 500), (9, "y x " * 3 + "x " * 300)], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.kept) for r in substrings.repeated_passages(docs).collect()}
    assert {(d, k) for d, _, k in got} == {(None, True), (-3, False), (5, False), (8, True), (8, False), (9, False)}
    # the same bytes by piece, and one chunk after the other of a word said over and over
    data = bytes(random.Random(1).choices(range(97, 110), k=30_000))
    whole = substrings.chunk_ends(data)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(substrings, "PIECE", 1000)
        assert substrings.chunk_ends(data) == whole
    same = b"word " * 200
    assert len({same[a:b] for a, b in zip(substrings.chunk_ends(same), substrings.chunk_ends(same)[1:-1])}) <= 2


def test_two_texts_of_one_id_do_not_mix(spark):
    p = " ".join(f"q{i}" for i in range(120))
    docs = spark.createDataFrame([(1, f"a {p} b", "m"), (1, "another " * 40, "m"), (2, f"c {p} d", "m"), (2, f"c {p} d", "m")], "doc_id long, text string, cuts string")
    got = substrings.repeated_passages(docs).where("doc_id IN (1, 2)").collect()
    assert {(r.doc_id, r.kept) for r in got} == {(1, True), (2, False)}
    out = substrings.cut_passages(docs)
    assert out.columns == docs.columns and out.count() == 4 and all(r.cuts == "m" for r in out.collect())
    assert all(len(r.text) < len(p) / 2 for r in out.where("doc_id = 2").collect())


def test_forest_ends_odd_rows_early():
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (500, 3)), rng.normal(9, 0.1, (3, 3))]
    score = quality.IsolationForest(x).score(x)
    assert score[500:].min() > np.quantile(score[:500], 0.99)
    assert quality._threshold(Counter({(900, 0): 5, (880, 0): 5, (100, 1): 1000, (885, 1): 1})) == 880
    assert quality._threshold(Counter({(900, 0): 5, (880, 0): 5, (100, 1): 100, (885, 1): 1})) == 900


def test_quality_catches_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("NOT base_failed").join(labels, "doc_id").collect()
    bad, good = ([r.kept for r in got if r.quality == x] for x in (0, 1))
    assert len(bad) >= 10 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.99 * len(good)


@pytest.mark.parametrize("hot", [1, 5, 4096])
def test_hot_classes_get_the_rows_of_others(spark, monkeypatch, hot):
    """Whatever is broadcast, joined or has no set: every row comes back, with the least id that its links reach."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(30))
    data = [(i, text(0)) for i in range(40)] + [(100 + i, text(1 + i % 9)) for i in range(27)] + [(200 + i, "") for i in range(12)] + [(None, text(0))] * 3
    # an id with three texts links their classes
    data += [(300, text(3)), (300, text(5)), (300, text(20))]
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = Counter()
    for i, t in data:
        k = None if i is None or not t else int(t.split("x")[0][1:])
        least = i if k is None else 0 if k == 0 else 102 if i == 300 or k in (3, 5) else 99 + k
        want[i, 26 if t else 0, least, i is None or i == least] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
