"""Spelling variants against comparing all pairs."""

import binascii
import random
import re

from nimboscale.llm.spelling import BLOCK, LONGEST, damaged_words, group_variants, near_words


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(counts: dict[str, int], ratio: int = 10) -> dict:
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def grouped(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in group_variants(df).collect()}


def test_all_pairs_of_crowded_words(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abéA") for _ in range(rng.randint(0, 7))) for _ in range(900)} | {"", "a", "b"}
    counts = {w: rng.choice([1, 2, 3, 15, 40, 200, 4000]) for w in sorted(words)}
    assert grouped(spark, counts) == brute(counts)


def test_long_words_around_the_seams(spark):
    rng = random.Random(6)
    words = set()
    for size in (LONGEST - 1, LONGEST, LONGEST + 1, 2 * BLOCK, 2 * BLOCK + 1, 100, 700):
        word = "".join(rng.choice("abcé") for _ in range(size))
        words.add(word)
        for at in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, size // 2, size - 1):
            words |= {word[:at] + word[at + 1 :], word[:at] + "z" + word[at + 1 :], word[:at] + "y" + word[at:], word + "x"}
    words |= {"a" * n for n in range(LONGEST - 3, LONGEST + 4)} | {"a" * 5000, "a" * 5001, "b" + "a" * 5000, "a" * 2500 + "b" + "a" * 2500}
    counts = {w: rng.choice([2, 30, 500]) for w in sorted(words)}
    assert grouped(spark, counts) == brute(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaaaa": 5000, "aaaaaaab": 500, "aaaaaaabc": 50, "aaaaaaabcd": 5, "baaaaaa": 5000, "zzzzzzz": 1}
    got = grouped(spark, counts)
    assert got == brute(counts)
    assert got["aaaaaaabcd"][1] == "aaaaaaa" and got["zzzzzzz"] == (None, "zzzzzzz", 1, 0, None)


def test_words_of_documents(spark):
    texts = [(i, f"Wanderer wanderer's ÄPFELBAUM äpfelbaum x{i} shorter LONGERwords\tlongerwords naïveté") for i in range(200)]
    texts += [(1000, None), (1001, ""), (None, "wanderer alonehere"), (7, "wanderer " * 3), (1002, "q" * 50_000), (1003, "q" * 50_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {}
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = binascii.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] = want.get(run, 0) + 1
    got = {r["word"]: r["n"] for r in damaged_words(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}


def test_edges(spark):
    df = spark.createDataFrame([("abcdefg", 40, "x"), ("abcdefh", 3, "y"), (None, 4, "z"), ("lonely", None, "z")], "word string, n long, root string")
    out = {r["word"]: r for r in group_variants(df).collect()}
    assert set(out) == {"abcdefg", "abcdefh"} and out["abcdefh"]["root"] == "abcdefg"
    assert group_variants(df.limit(0)).count() == 0
    assert near_words(df.where("word = 'abcdefg'")).count() == 0
