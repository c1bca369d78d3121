"""Spelling variants grouped through a variable-length gram index.

Words are runs of letters, lower-cased (A-Z only).  Two words are near if they
differ by exactly one inserted, deleted or replaced code point; a word's form is
the near word that is far more frequent, and following forms leads to its root.

Gram dictionary.  Words stand between two marks.  All grams of two code points
belong to the dictionary, longer ones (up to ``LONGEST``) only where the gram
they extend is frequent: more than a threshold that starts at ``FREQUENT`` and is
raised until the dictionary holds at most ``MAX_GRAMS``.  So rare grams stay
short and frequent ones are told apart by what follows.

Decomposition.  At every place the longest gram of the dictionary is taken, and
dropped if an earlier one reaches as far.

Affected grams.  An edit behind a prefix leaves those grams alone that end in the
prefix, unless a longer gram of the dictionary could start there and run into
the edit; in the same way for the suffix, with grams that could end in it.  What
is left of both sides is the same for both words of a near pair.  With marks a
word has at least twice ``LONGEST`` code points, so something is always left.

List merging.  For every place of an edit a word is listed under all grams that
the edit leaves: the hash of these grams and the number of code points kept is the key, so
members of a list are members of the merged lists of all these grams.  Members
are verified by their edit distance.  Lists of more than ``CROWD`` words are not
joined to pairs; their words meet on all the letters that an edit keeps, which is
exact and makes near pairs only.

Null texts have no words, null ids count as empty text.  Counts and everything
after them cover all documents; repeated rows count each; an empty table gives an
empty result.  Very long words are words like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import broadcast_if_small
from .tables import Table
from .text import lower_ascii

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
LONGEST = 4
FREQUENT = 32
MAX_GRAMS = 100_000
CROWD = 200
TYPO_EVERY = 31
FAR_MORE = 10  # times as frequent as the variant
_SLICE = 5_000


class Grams(NamedTuple):
    """Dictionary grams of three and more code points, and their proper prefixes and suffixes."""

    grams: frozenset
    prefixes: frozenset
    suffixes: frozenset


def gram_index(grams) -> Grams:
    """The dictionary as sets; grams of two code points need no entry, as all of them belong to it."""
    long = frozenset(g for g in grams if len(g) > 2)
    return Grams(long, frozenset(g[:n] for g in long for n in range(2, len(g))), frozenset(g[-n:] for g in long for n in range(1, len(g))))


def decomposed(marked: str, index: Grams, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Start and end of the grams of a marked word."""
    out, reached = [], 0
    for p in range(len(marked) - 1):
        end = p + 2
        for q in range(min(longest, len(marked) - p), 2, -1):
            if marked[p : p + q] in index.grams:
                end = p + q
                break
        if end > reached:
            out.append((p, end))
            reached = end
    return out


def untouched(marked: str, grams: list[tuple[int, int]], index: Grams, longest: int = LONGEST) -> tuple[list[int], list[int]]:
    """For each place: how many first grams an edit from there on leaves, and from which gram on one before it leaves them."""
    size = len(marked)
    left, right = [0] * (size + 1), [len(grams)] * (size + 1)
    for b in range(1, size):
        least = b - 1
        for p in range(max(0, b - longest + 1), b - 1):
            if marked[p:b] in index.prefixes:
                least = p
                break
        n = left[b - 1]
        while n < len(grams) and grams[n][1] <= b and grams[n][0] < least:
            n += 1
        while n and grams[n - 1][0] >= least:
            n -= 1
        left[b] = n
    for j in range(1, size):
        most = j
        for e in range(min(size, j + longest - 1), j, -1):
            if marked[j:e] in index.suffixes:
                most = e
                break
        right[j] = next((k for k, (p, e) in enumerate(grams) if p >= j and e > most), len(grams))
    return left, right


def merged_lists(word: str, index: Grams, longest: int = LONGEST) -> tuple[set[int], set[int]]:
    """Keys of the lists a word stands in if one of its code points is touched, and if one is put between them."""
    marked = f"^{word}$"
    grams = decomposed(marked, index, longest)
    left, right = untouched(marked, grams, index, longest)
    texts = [marked[a:b] for a, b in grams]

    def key(n: int, m: int, kept: int) -> int:
        return xxhash.xxh64_intdigest(f"{kept} {' '.join(texts[:n])}|{' '.join(texts[m:])}") - (1 << 63)

    touched = {(left[i], right[i + 1]) for i in range(1, len(marked) - 1)}
    between = {(left[i], right[i]) for i in range(1, len(marked))}
    return {key(n, m, len(word) - 1) for n, m in touched}, {key(n, m, len(word)) for n, m in between}


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """``word`` and ``n`` of all words; where ``typo_every`` divides a run's checksum it loses a code point."""
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h, at = F.col("h"), (F.col("h") % F.length("run")).cast("int")
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    rows = rows.select(F.when(h % typo_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def gram_dictionary(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, max_grams: int = MAX_GRAMS) -> list[str]:
    """Grams of three and more code points whose prefix, shorter by one, is frequent among the words."""
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    of = lambda q: F.transform(F.sequence(F.lit(1), F.length("w") - (q - 1)), lambda p: F.substring("w", p, F.lit(q)))
    grams = marked.select(F.explode(F.concat(*[of(q) for q in range(2, longest + 1)])).alias("gram"))
    counted = Table(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    stems = counted.rows.filter((F.length("gram") < longest) & (F.col("n") > frequent)).select(F.col("gram").alias("stem"), F.col("n").alias("of"))
    longer = counted.rows.filter(F.length("gram") > 2).select("gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("stem"))
    extended = Table(longer.join(broadcast_if_small(stems), "stem").select("gram", "of"))
    levels = [min((frequent + 1 << k) - 1, 1 << 62) for k in range(63)]
    sizes = extended.rows.agg(*[F.count_if(F.col("of") > t).alias(f"n{k}") for k, t in enumerate(levels)]).first()
    level = next(t for k, t in enumerate(levels) if sizes[k] <= max_grams)
    found = [r["gram"] for r in extended.rows.filter(F.col("of") > level).collect()]
    counted.drop(), extended.drop()
    return found


def _list(batches: Iterator[pd.DataFrame], shared: Broadcast, longest: int) -> Iterator[pd.DataFrame]:
    index = gram_index(shared.value)
    for batch in batches:
        for at in range(0, len(batch), _SLICE):
            rows = []
            for word, n in zip(batch["word"].iloc[at : at + _SLICE], batch["n"].iloc[at : at + _SLICE]):
                touched, between = merged_lists(word, index, longest)
                rows += [(k, True, word, n) for k in touched]
                rows += [(k, False, word, n) for k in between]
            yield pd.DataFrame(rows, columns=["key", "touched", "word", "n"])


def near_words(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, max_grams: int = MAX_GRAMS, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, n_a, b, n_b) of near words, a before b; ``words`` has word and n, words have 2 * longest - 2 code points at least."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, longest, frequent, max_grams))
    schema = "key long, touched boolean, word string, n long"
    listed = Table(words.select("word", "n").mapInPandas(lambda it: _list(it, shared, longest), schema)).rows
    # A pair needs two members, of which one was touched.
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bool_or("touched").alias("any")).filter("any AND members > 1")
    sizes = Table(sizes.select("key", "members")).rows
    few = listed.join(sizes.filter(F.col("members") <= crowd), "key")
    one, other = (few.select("key", *[F.col(c).alias(c + s) for c in ("word", "n", "touched")]) for s in ("_1", "_2"))
    # Both touched: same length, each pair once.  One touched: it is the longer one.
    meet = F.col("touched_1") & (~F.col("touched_2") | (F.col("word_1") < F.col("word_2")))
    met = one.join(other, "key").filter(meet & (F.levenshtein("word_1", "word_2", 1) == 1))
    many = listed.join(sizes.filter(F.col("members") > crowd).select("key"), "key", "left_semi").select("word", "n", "touched").distinct()
    places = F.posexplode(F.sequence(F.lit(1), F.length("word") + F.when(F.col("touched"), 0).otherwise(1))).alias("i", "at")
    many = many.select("word", "n", "touched", places)
    kept = F.when(F.col("touched"), F.concat(F.expr("substring(word, 1, i)"), F.expr("substring(word, at + 1)"))).otherwise(F.col("word"))
    many = many.select(kept.alias("kept"), "at", "word", "n", "touched")
    one, other = (many.select("kept", "at", *[F.col(c).alias(c + s) for c in ("word", "n", "touched")]) for s in ("_1", "_2"))
    exact = one.join(other, ["kept", "at"]).filter(meet & (F.col("word_1") != F.col("word_2")))
    columns = ["word_1", "n_1", "word_2", "n_2"]
    pairs = met.select(columns).union(exact.select(columns))
    first = F.col("word_1") < F.col("word_2")
    turned = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in
              (("word_1", "word_2", "a"), ("n_1", "n_2", "n_a"), ("word_2", "word_1", "b"), ("n_2", "n_1", "n_b"))]
    return pairs.select(*turned).distinct()


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms; each round doubles the steps taken."""
    reached = Table(forms.select("word", F.col("form").alias("root"))).rows
    for _ in range(rounds):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reached.join(broadcast_if_small(ahead), "root", "left")
        reached = Table(step.select("word", F.coalesce("further", "root").alias("root"))).rows
    return reached


def best_form(far_more: int) -> Column:
    """The near word of largest count (ties: the smallest) if it is ``far_more`` times as frequent."""
    return F.when(-F.col("best.minus") >= F.col("n") * far_more, F.col("best.near"))


def spelling_forms(docs: DataFrame, far_more: int = FAR_MORE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                   typo_every: int = TYPO_EVERY, **index) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of (doc_id, text)."""
    if index.get("longest", LONGEST) * 2 > least_length + 2:
        raise ValueError("longest may be half of least_length + 2 at most")
    words = Table(word_counts(docs, least_length, least_count, typo_every)).rows
    pairs = Table(near_words(words, **index)).rows
    ends = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("near")).alias("one"))
    ends = ends.union(pairs.select("b", F.struct((-F.col("n_a")).alias("minus"), F.col("a").alias("near"))))
    near = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("one").alias("best"))
    known = Table(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                  best_form(far_more).alias("form"), (-F.col("best.minus")).alias("form_n"))).rows
    # Counts grow by far_more with every step, so the largest one bounds the chains.
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(max(largest / least_count, 1), max(far_more, 2))) + 1)
    chain = roots(known.filter("form IS NOT NULL"), math.ceil(math.log2(steps)))
    found = known.join(broadcast_if_small(chain), "word", "left")
    form_n = F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", form_n)
