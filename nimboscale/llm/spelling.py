"""Spelling variants: words one edit apart, found by a trie that is a table.

Plan: the distinct words become two tries, one of the words and one of the
words reversed, kept as a table of nodes (depth, node, next letters). The states
(word, position, node, edits) of all words move down level by level, each level
one join of the frontier with the nodes of its depth. A word enters a trie at
its middle without an edit: an edit in its second half is found in the one trie,
an edit in its first half in the other, so that no state ever meets the crowded
top. A state that has spent its edit lives on only where the trie holds the rest of
its word, and one that ends on a whole word makes the two neighbours. Each letter of a node comes
with the lengths and next letters of the words behind it, so that states without a future are not made. Letters
after a node are a list bounded by the alphabet, so a state never has more
successors than that, and no two words are ever compared for sharing a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from nimboscale.llm.text import ascii_lower, without
from nimboscale.session import discard, gathered, new_shared_path, stored

#: Words up to this many code points walk whole; longer ones walk block by block (see ``_long_items``).
LONGEST = 40
#: Code points a block of a longer word.
BLOCK = 32
#: A level's nodes up to this many are broadcast.
FEW_NODES = 50_000

RUNS = r"[A-Za-zÀ-ÿ]"
OUT = ("form", "root", "n_near", "form_n")


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, one letter missing where the CRC says so, that are long and frequent enough.

    With h the CRC32 of ``<id>:<run>``, runs whose h is a multiple of ``every``
    lose the code point h modulo their length. A null id counts as an empty one; a
    null text has no words; every row counts, repeated ones too.
    """
    # A shorter run cannot become long enough.
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUNS}{{{min_chars},}})"), F.lit(1))).alias("_run"))
    runs = runs.select("_id", ascii_lower(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), F.col("_run")).cast("binary"))
    at = (h % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("_run")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _by(df: DataFrame, column: str) -> DataFrame:
    """``df`` stored with a folder for each value of ``column``."""
    path = new_shared_path(df.sparkSession, "trie")
    df.write.partitionBy(column).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._nimboscale_path = path
    return out


def _blocks(batches):
    """Items of long words: for each length of the shorter word of a pair, and for each block that may hold the edit, what lies between an agreed prefix and an agreed suffix."""
    import hashlib

    import pandas as pd

    for batch in batches:
        out = []
        for word in batch["word"]:
            size = len(word)
            key = "\x00" + hashlib.sha256(word.encode()).hexdigest()

            def chain(text: str) -> list[bytes]:
                # Digest of each prefix of whole blocks.
                state, found = hashlib.blake2b(digest_size=12), []
                for at in range(0, len(text) + 1, BLOCK):
                    found.append(state.digest())
                    state.update(text[at : at + BLOCK].encode())
                return found

            heads = chain(word)
            for shorter in (size, size - 1):
                blocks = -(-shorter // BLOCK)
                # Suffixes are as long as the shorter word leaves after each block.
                tail_sizes = [max(0, shorter - BLOCK * (j + 1)) for j in range(blocks)]
                state, done, tails = hashlib.blake2b(digest_size=12), 0, {0: b""}
                for tail in sorted(set(tail_sizes) - {0}):
                    state.update(word[size - tail : size - done][::-1].encode())
                    done, tails[tail] = tail, state.digest()
                for j in range(blocks if shorter >= LONGEST else 0):
                    place = hashlib.blake2b(f"{shorter}:{j}:".encode() + heads[j] + tails[tail_sizes[j]], digest_size=8).digest()
                    out.append((int.from_bytes(place, "big", signed=True) | 2, word[BLOCK * j : size - tail_sizes[j]], key))
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=["place", "s", "key"])
                        out = []
        yield pd.DataFrame(out, columns=["place", "s", "key"])


def _long_items(words: DataFrame) -> DataFrame:
    """(place, s, key) of words of at least ``LONGEST`` letters: words of one place agree outside ``s``, which is short."""
    items = words.where(F.char_length("word") >= LONGEST).select("word").mapInPandas(_blocks, "place bigint, s string, key string")
    items = stored(items, "long-words")
    shared = items.groupBy("place").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("place")
    return items.join(shared, "place", "left_semi")


def _letter(s: Column, after: Column) -> Column:
    """The letter after ``after`` letters; empty past the end."""
    return F.substring(s, after + 1, F.lit(1))


def _bit(n: Column) -> Column:
    """A long with the bit n modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(n, F.lit(64)).cast("int"))


def _neighbours(items: DataFrame) -> DataFrame:
    """(tree, s, key, node): items of one ``place`` one edit apart; ``s`` and ``node`` are read backwards in odd trees."""
    halves = items.withColumn("_way", F.explode(F.array(F.lit(0), F.lit(1))))
    size = F.char_length("s")
    half = F.floor(size / 2).cast("int")
    walkers = _by(
        halves.select(
            # Even trees hold the words, odd ones the words read backwards.
            F.col("place").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("_way").cast("bigint")).alias("tree"),
            F.when(F.col("_way") == 0, F.col("s")).otherwise(F.reverse("s")).alias("s"),
            "key",
            F.when(F.col("_way") == 0, half).otherwise(size - half).alias("start"),
        ),
        "start",
    )
    # The node after i letters has the letter i + 1 behind it, the whole word an empty letter.
    steps = walkers.select("tree", "s", F.explode(F.sequence(F.col("start"), F.char_length("s"))).alias("depth"))
    edges = steps.select(
        "depth", "tree", F.substring("s", F.lit(1), F.col("depth")).alias("node"), _letter(F.col("s"), F.col("depth")).alias("letter"),
        # Of the words behind the letter: how many letters follow it, and which comes next.
        _bit(F.char_length("s") - F.col("depth") - 1).alias("left"), _bit(F.ascii(_letter(F.col("s"), F.col("depth") + 1))).alias("next"),
    )
    edges = edges.groupBy("depth", "tree", "node", "letter").agg(F.bit_or("left").alias("left"), F.bit_or("next").alias("next"))
    nodes = _by(edges.groupBy("depth", "tree", "node").agg(F.collect_list(F.struct("letter", "left", "next")).alias("letters")), "depth")
    least, most = walkers.agg(F.min("start"), F.max(F.char_length("s"))).first()
    pairs, frontier = [], None
    for level in range(least or 0, (most or -1) + 1):
        entering = walkers.where(F.col("start") == level).select("tree", F.substring("s", 1, level).alias("node"), "s", "key", F.lit(level).alias("pos"), F.lit(0).alias("edits"))
        states = entering if frontier is None else frontier.select("tree", "node", "s", "key", "pos", "edits").unionByName(entering)
        here = gathered(nodes.where(F.col("depth") == level).select("tree", "node", "letters"), FEW_NODES)
        met = states.join(here, ["tree", "node"])
        size = F.char_length("s")
        ahead = [_letter(F.col("s"), F.col("pos") + k) for k in range(3)]

        def move(by: int, edits: int):
            return lambda x: F.struct((F.col("pos") + by).alias("pos"), F.concat("node", x["letter"]).alias("node"), F.lit(edits).alias("edits"), (x["letter"] == "").alias("done"))

        def behind(x: Column, by: int) -> Column:
            """Whether words of the right length, with the right next letter, stand behind the letter."""
            return ((x["left"].bitwiseAND(_bit(size - F.col("pos") - by)) != 0) & (x["next"].bitwiseAND(_bit(F.ascii(ahead[by]))) != 0)) | (x["letter"] == "")

        same = F.transform(F.filter("letters", lambda x: x["letter"] == ahead[0]), move(1, 0))
        # Replacements go to larger letters only: the other word of the pair does not need to find it again.
        other = F.transform(F.filter("letters", lambda x: (x["letter"] > ahead[0]) & behind(x, 1)), move(1, 1))
        left_out = F.transform(F.filter("letters", lambda x: (x["letter"] == ahead[1]) & behind(x, 2)), move(2, 1))
        spent = F.transform(F.filter("letters", lambda x: (x["letter"] == ahead[0]) & behind(x, 1)), move(1, 1))
        moves = F.when(F.col("edits") == 1, spent).when(F.col("pos") < size, F.concat(same, other, left_out))
        out = _by(met.select("tree", "s", "key", F.inline(moves)), "done")
        if frontier is not None:
            discard(frontier)
        frontier = out.where("NOT done")
        frontier._nimboscale_path = f"{out._nimboscale_path}/done=false"
        pairs.append(out.where("done").select("tree", "s", "key", "node"))
    if frontier is not None:
        discard(frontier)
    discard(walkers, nodes)
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    return found


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of ``word`` that differ by exactly one inserted, deleted or replaced code point, each once."""
    way = lambda c: F.when(F.col("tree").bitwiseAND(F.lit(1)) == 0, F.col(c)).otherwise(F.reverse(c))
    short = words.where((F.char_length("word") <= LONGEST) & (F.char_length("word") > 0))
    found = _neighbours(short.select(F.lit(0).cast("bigint").alias("place"), F.col("word").alias("s"), F.lit(None).cast("string").alias("key"))) if not short.isEmpty() else None
    pairs = words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0) if found is None else found.select(way("s").alias("a"), way("node").alias("b"))
    # One letter and the empty word.
    if not words.where(F.col("word") == "").isEmpty():
        pairs = pairs.unionByName(words.where(F.char_length("word") == 1).select(F.lit("").alias("a"), F.col("word").alias("b")))
    long = words.where(F.char_length("word") > LONGEST)
    if not long.isEmpty():
        items = stored(_long_items(words), "long-items")
        if not items.isEmpty():
            met = _neighbours(items).select(F.col("tree").bitwiseAND(F.lit(-2)).alias("place"), way("node").alias("s"), "key")
            met = met.join(items.select(F.col("place").bitwiseAND(F.lit(-2)).alias("place"), "s", F.col("key").alias("_other")), ["place", "s"])
            keys = words.where(F.char_length("word") >= LONGEST).select("word", F.concat(F.lit("\x00"), F.sha2("word", 256)).alias("_k"))
            met = met.select("key", "_other").distinct()
            met = met.join(keys.select(F.col("_k").alias("key"), F.col("word").alias("a")), "key").join(keys.select(F.col("_k").alias("_other"), F.col("word").alias("b")), "_other")
            # Places are digests: hold each pair against its words.
            pairs = pairs.unionByName(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Add ``form``, ``root``, ``n_near`` and ``form_n`` to distinct words with their counts ``n``.

    ``n_near`` is the number of words exactly one edit away. ``form`` is the one of
    largest ``n`` among them (ties: the smallest in code-point order) if that n is at least
    ``ratio`` times the word's own, else null; ``form_n`` is its n; ``root`` is where
    following forms ends, the word itself if it has none.

    Edge cases: null words and words without a count are left out; an empty word is a word
    of length zero. Words must be distinct. Lengths have no bound: words of more than
    40 code points are cut into blocks of which one may differ. Input columns named
    like an output are replaced, others pass through. An empty table gives an empty table.
    """
    words = stored(without(words, *OUT).where(F.col("word").isNotNull() & F.col("n").isNotNull()), "words")
    counts = words.select("word", F.col("n").cast("bigint").alias("n"))
    pairs = stored(near_words(counts), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("_other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("_other")))
    both = both.join(counts.select(F.col("word").alias("_other"), F.col("n").alias("_n")), "_other")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("_other").alias("form"))).alias("_best"))
    known = counts.join(best, "word", "left")
    enough = -F.col("_best.less") >= F.col("n") * ratio
    known = stored(known.select("word", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("_best.form")).alias("form"), F.when(enough, -F.col("_best.less")).alias("form_n")), "forms")
    up = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Every form has `ratio` times the count: a chain has log(largest) links at most, and each round doubles what is followed.
    largest = max(2, counts.agg(F.max("n")).first()[0] or 2)
    links = math.log(largest) / math.log(ratio) + 1 if ratio > 1 else largest
    for _ in range(max(1, math.ceil(math.log2(links + 1)))):
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        up = stored(up.join(higher, "root", "left").select("word", F.coalesce("_up", "root").alias("root")), "roots")
    return words.join(known, "word").join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    words = damaged_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC by bytes from a table that the polynomial gives; neighbours by a deleted letter and its place.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
  GROUP BY ALL
),
hexed AS (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM runs WHERE length(w) >= 7),
hashed AS (
  SELECT w, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || h[2*i+1:2*i+2])::BIGINT for i in range(length(h) // 2)]),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8))) AS h
  FROM hexed, crc
),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed
),
words AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
  SELECT a.word AS w, b.word AS o FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, s.word FROM less l JOIN words s ON l.d = s.word
  UNION SELECT s.word, l.word FROM less l JOIN words s ON l.d = s.word
),
best AS (
  SELECT w AS word, count(*) AS n_near, min({'less': -x.n, 'o': p.o}) AS b
  FROM pairs p JOIN words x ON x.word = p.o GROUP BY w
),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -b.less >= 10 * v.n THEN b.o END AS form, CASE WHEN -b.less >= 10 * v.n THEN -b.less END AS form_n
  FROM words v LEFT JOIN best USING (word)
),
climb AS (
  SELECT word, coalesce(form, word) AS root FROM formed
  UNION SELECT c.word, f.form FROM climb c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN climb c ON c.word = f.word JOIN formed r ON r.word = c.root AND r.form IS NULL
"""
