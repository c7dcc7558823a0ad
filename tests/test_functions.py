"""Functions against rows with known results, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from swaralens.functions import english, lexicons, metrics, numbers, spell, text
from swaralens.functions.lattice import align_words, path, score_bins


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f("c").alias("r")).first()["r"]


@pytest.mark.parametrize("given, expected", [("नमस्ते, दुनिया!", "नमस्ते दुनिया"), ("a - b", "a  b"), ("5.5", "55"), ("क​ख", "कख"), ("है।", "है।"), (" \x1c a　b ", "a b"), ("", ""), (None, None)])
def test_clean_transcript(spark, given, expected):
    assert one(spark, given, text.clean_transcript) == expected


def test_tokens_match_python_split(spark):
    rng = random.Random(1)
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    given = ["".join(rng.choice(blanks + "abक​") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", text.tokens("t").alias("w"), text.strip("t").alias("s")).collect()
    for r in rows:
        assert r["w"] == r["t"].split() and r["s"] == r["t"].strip()


@pytest.mark.parametrize("word, roman, latin, ascii_", [("interview,", True, True, True), ("1st", True, True, True), ("a1", False, True, True), ("aक", False, False, True), ("Łódź", False, False, True), ("₹500", False, False, False), ("", False, False, False)])
def test_three_roman_tests(spark, word, roman, latin, ascii_):
    assert (one(spark, word, text.is_roman_word), one(spark, word, text.is_latin_token), one(spark, word, text.has_ascii_letter)) == (roman, latin, ascii_)


def test_round_even_and_reason_prefix(spark):
    row = spark.range(1).select(text.round_even(F.lit(1) / F.lit(32) * 100, 2).alias("a"), text.reason_prefix(F.lit("abc; def")).alias("b"), text.reason_prefix(F.lit(None).cast("string")).alias("c"), text.title_id(F.lit("word_boundary")).alias("d")).first()
    assert tuple(row) == (3.12, "abc", "unspecified", "Word Boundary")


def test_number_tables():
    assert set(lexicons.ONES.values()) == set(range(100)) and len(lexicons.ONES) == 102
    assert len(lexicons.MULTIPLIERS) == 7 and len(lexicons.IDIOMS) == 19 and len(lexicons.SUFFIXES) == 41 and len(lexicons.LOAN_SPELLINGS) == 42


def test_number_value_agrees_with_the_arrow_path(spark):
    rng = random.Random(2)
    words = [*lexicons.ONES, *lexicons.MULTIPLIERS]
    spans = [[rng.choice(words) for _ in range(rng.randint(1, 4))] for _ in range(300)]
    rows = spark.createDataFrame([(s,) for s in spans], "w array<string>").select("w", numbers.number_value(F.col("w")).alias("v")).collect()
    for r in rows:
        exact = numbers._value(r["w"])
        assert r["v"] == (exact if 0 < exact < 2**63 else None)


def test_english_tags_can_be_stripped(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", english.strip_tags(english.detect_english("text")["tagged"]).alias("s"))
    assert docs.where("text <> s").count() == 0


def test_spell_signals_with_all_sources(spark):
    from swaralens.operators.spelling import spell_classify

    words = spark.createDataFrame([("कखग",), ("भारत",), ("",), (None,)], "word string")
    listed = spark.createDataFrame([(" कखग ",)], "word string")
    known = spark.createDataFrame([("भारत",)], "word string")
    corpus = spark.createDataFrame([("अब अब",)], "line string")
    got = {r["word"]: r for r in spell_classify(words, listed, known, corpus, with_signals=True).collect()}
    assert got["कखग"]["reason"] == "Found in verified Hindi wordlist" and got["भारत"]["reason"] == "Validated by Hunspell Hindi dictionary"
    assert got[""]["confidence"] == "high" and got[""]["signals"] == {} and got["कखग"]["signals"]["in_custom_wordlist"] is True


def test_bigram_scores(spark):
    import math

    from swaralens.operators.spelling import bigram_scores, char_counts

    corpus = spark.createDataFrame([("अब अब",)], "line string")
    words = spark.createDataFrame([("अब",), ("बअ",), ("अ",)], "word string")
    got = {r["word"]: r["bigram_score"] for r in bigram_scores(words, *char_counts(corpus)).collect()}
    assert got["अब"] == pytest.approx(math.log(3 / 5)) and got["बअ"] == pytest.approx(math.log(1 / 5)) and got["अ"] == 0.0


@pytest.mark.parametrize("reference, hypothesis, rate", [("", "", 0.0), ("", "x", 1.0), ("a b c d", "a x c d", 25.0), ("A b", "a B", 0.0), ("a", "a b c", 200.0), ("क्या", "क्या?", 100.0)])
def test_standard_wer(spark, reference, hypothesis, rate):
    df = spark.createDataFrame([(reference, hypothesis)], "r string, h string")
    assert df.select(metrics.standard_wer("r", "h").alias("w")).first()["w"] == rate


def test_token_distance_is_a_metric(spark):
    rng = random.Random(3)
    lists = [[rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(30)]
    triples = [(rng.choice(lists), rng.choice(lists), rng.choice(lists)) for _ in range(100)]
    df = spark.createDataFrame(triples, "a array<string>, b array<string>, c array<string>")
    d = lambda x, y: metrics.token_distance(F.col(x), F.col(y))
    for r in df.select(d("a", "a").alias("aa"), d("a", "b").alias("ab"), d("b", "a").alias("ba"), d("b", "c").alias("bc"), d("a", "c").alias("ac"), "a", "b").collect():
        assert r["aa"] == 0 and r["ab"] == r["ba"] and r["ac"] <= r["ab"] + r["bc"]
        found = align_words(r["a"], r["b"])
        assert r["ab"] == sum(i < 0 or j < 0 or r["a"][i] != r["b"][j] for i, j in found)


def naive_path(n, m, same):
    """By the whole table: a match or substitution before a deletion before an insertion, from the end."""
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (not same(i - 1, j - 1)), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (not same(i - 1, j - 1)):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


@pytest.mark.parametrize("block", [None, 1, 3])
def test_paths_by_the_whole_table(block):
    import numpy as np

    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        want = naive_path(len(x), len(y), lambda i, j: x[i] == y[j])
        assert path(len(x), len(y), lambda i: np.array([c != x[i] for c in y], bool), block) == want
        sets = [frozenset(rng.sample("abcd", rng.randint(0, 3))) for _ in x]
        found = naive_path(len(sets), len(y), lambda i, j: y[j] in sets[i])
        assert score_bins(sets, y) == (sum(i >= 0 <= j and y[j] not in sets[i] for i, j in found), sum(j < 0 for _, j in found), sum(i < 0 for i, _ in found))


def test_long_texts_are_aligned_in_little_memory():
    import tracemalloc

    rng = random.Random(5)
    x = [str(rng.randrange(500)) for _ in range(6000)]
    y = [w for w in x if rng.random() > 0.1]
    tracemalloc.start()
    found = align_words(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 6000 and sum(j < 0 for _, j in found) == 6000 - len(y) and peak < 30e6


def test_english_words_in_texts_of_either_kind(spark):
    """The fast way, for texts without letters beyond Latin-1, finds what the token by token one does."""
    rng = random.Random(6)
    given = ["".join(rng.choice("ab1é.,- \t\x1cकŁ") for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["", "x", " ", None]

    def latin(t):
        letters = [c for c in t if c.isalpha()]
        return sum(ord(c) < 256 for c in letters) * 2 > len(letters)

    df = spark.createDataFrame([(t,) for t in given], "t string").withColumn("e", english.detect_english("t"))
    for r in df.collect():
        if r["t"] is None:
            assert r["e"]["tagged"] is None
            continue
        assert r["e"]["words"] == [w for w in r["t"].split() if latin(w)], r
        assert english.OPEN.join(r["e"]["tagged"].split(english.OPEN)) == r["e"]["tagged"] and r["e"]["tagged"].replace("[EN]", "").replace("[/EN]", "") == r["t"]


def test_virama_and_confidence(spark):
    bad = lambda c: spell.has_bad_virama(F.col(c))
    assert one(spark, "भारत्", bad) is True and one(spark, "नमस्ते", bad) is False


def test_additive_numbers():
    assert numbers.spoken_to_digits("एक लाख पाँच हज़ार", additive=True) == "105000" and numbers.spoken_to_digits("एक लाख पाँच हज़ार") == "100005000"
