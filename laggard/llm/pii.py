"""Personal data: identifiers by pattern, and the terms that give them away.

Identifiers.  E-mail and IP addresses, card and phone numbers are found in whole
texts.  ``split`` and ``regexp_extract_all`` with one pattern return the gaps and
the matches, and a fold over both gives positions.  The patterns are written
without backtracking over long runs (possessive repeats; an e-mail or an IP may
only start where its run of characters starts, or where the last match ended),
which changes no match.

Terms.  Every identifier is an entity to protect, and every other word of a
document that mentions it is a term that may reveal it, wherever it stands.  With
n(e), n(t) and n(e, t) the numbers of documents with the entity, the term, and
both, of N documents, the disclosure of e by t is PMI(e, t) / IC(e): the share of
the entity's information that the term carries.  n(t) is taken one larger, as if
the term had been seen once more without the entity; so a term of a single
document discloses 1 - 1 / log2 N, less in a small corpus than in a large one.
Terms above ``REMOVE`` are removed, terms above ``GENERALISE`` are replaced by a
placeholder, in every document that mentions the entity.

Entities of the same documents have the same counts with every term; they are
one class, so a text with very many identifiers makes no product of identifiers
and words.

Everything is DataFrame expressions and groupings with map-side combination.
Folds over the matches of a text go in sections of ``SECTION``, so that their work
is in proportion to the text.  The revealing terms are joined to the words of
each different text, and their places come back by a join on a digest of the
text; it is broadcast only when a count shows at most ``FEW_TERMS`` places in all.

Null texts are empty.  Equal texts are treated alike, whatever their ids; other
columns are kept, but columns with the names of those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import broadcast_if_small
from .tables import Table

GENERALISE = 0.75
REMOVE = 0.85
FEW_TERMS = 100_000
SECTION = 256
_CUT = 4_096  # code points

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}[\p{L}\p{M}]{2,}+"
ADDED = (*KINDS, "term")
SPANS = "array<struct<start:int,end:int,value:string>>"
TERM_SPAN = "struct<start:int,end:int,value:string,removed:boolean>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0)) * (i % 2 + 1)
        return F.when(n > 9, n - 9).otherwise(n)

    worths = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.aggregate(worths, F.lit(0), lambda a, n: a + n) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(items: Column, advance) -> Column:
    """Every item with the state ``before`` it: an int from 0 that each item advances."""

    def of(sections: Column) -> Column:
        after = lambda at, section: F.aggregate(section, at, advance)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda state, c: F.struct(after(state["at"], c).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))
        starts = F.aggregate(sections, begin, step, lambda state: state["starts"])

        def one(section: Column, start: Column) -> Column:
            # States before the items of one section.
            more = lambda states, x: F.concat(states, F.array(advance(F.element_at(states, -1), x)))
            return F.arrays_zip(section.alias("item"), F.slice(F.aggregate(section, F.array(start), more), 1, F.size(section)).alias("before"))

        return F.flatten(_let(starts, lambda s: F.transform(sections, lambda section, i: one(section, F.get(s, i)))))

    def cut(all_: Column) -> Column:
        last = F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / SECTION).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_, i * SECTION + 1, F.lit(SECTION)))

    return _let(_let(items, cut), of)


def _located(text: Column, pattern: str, valid) -> Column:
    """Spans of the valid matches, in order."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    parts = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.coalesce(F.length(p["hit"]), F.lit(0)).alias("size"), p["hit"].alias("hit")))
    placed = _running(parts, lambda at, p: at + p["gap"] + p["size"])
    hits = F.filter(placed, lambda p: p["item"]["hit"].isNotNull() & valid(p["item"]["hit"]))

    def span(p: Column) -> Column:
        start = p["before"] + p["item"]["gap"]
        return F.struct(start.alias("start"), (start + p["item"]["size"]).alias("end"), p["item"]["hit"].alias("value"))

    return F.transform(hits, span)


def _none() -> Column:
    return F.array().cast(SPANS)


def identifiers(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one array of spans (start, end, value; code points) per kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    may = {"email": F.contains(body, F.lit("@")), "phone": F.contains(body, F.lit("+"))}
    digit = body.rlike("[0-9]")
    return docs.withColumns({
        k: F.when(may.get(k, digit), _located(body, PATTERNS[k], lambda v, k=k: _valid(k, v))).otherwise(_none()) for k in KINDS
    })


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def mentions(docs: DataFrame) -> DataFrame:
    """One row per text with an entity: its ``key``, ``entities``, ``terms`` and ``copies``."""
    marked = identifiers(docs.select("text"))
    plain = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(kind + ":"), plain[kind](s["value"])))

    entities = F.array_distinct(F.concat(*[named(k) for k in KINDS]))
    rows = marked.select("text", entities.alias("entities")).filter(F.size("entities") > 0)
    rest = F.regexp_replace("text", r"\S*[@0-9]\S*", " ")
    rows = rows.select(text_key(F.col("text")).alias("key"), "entities", _words(rest).alias("terms"))
    return rows.groupBy("key").agg(F.any_value("entities").alias("entities"), F.any_value("terms").alias("terms"), F.count(F.lit(1)).alias("copies"))


def _classes(found: DataFrame) -> DataFrame:
    """``key``, ``copies``, ``terms`` and the ``classes`` (id, n_e) of the texts' entities: those of the same texts are one."""
    each = found.select("key", "copies", F.explode("entities").alias("entity"))
    # Which texts an entity is in, as two checksums of their keys.
    where = [F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64(F.lit("again"), "key"))]
    of = each.groupBy("entity").agg(F.struct(*where).alias("id"), F.sum("copies").alias("n_e"))
    per_text = each.join(of, "entity").select("key", F.struct("id", "n_e").alias("one")).distinct()
    per_text = per_text.groupBy("key").agg(F.collect_list("one").alias("classes"))
    return found.select("key", "copies", "terms").join(per_text, "key")


def disclosing_terms(docs: DataFrame, classed: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``id`` (of the class), ``term``, ``disclosure`` and ``removed`` of the terms above the threshold."""
    pairs = classed.select("copies", F.explode("classes").alias("class"), "terms").select("copies", "class.*", F.explode("terms").alias("term"))
    near = pairs.groupBy("id", "n_e", "term").agg(F.sum("copies").alias("n_et"))
    words = docs.select(F.explode(_words(F.col("text"))).alias("term"))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = F.lit(float(docs.count()))
    rows = near.join(terms, "term")
    information = F.log2(total / F.col("n_e"))
    pmi = F.log2(total * F.col("n_et") / (F.col("n_e") * (F.col("n_t") + 1)))
    rows = rows.withColumn("disclosure", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)))
    return rows.filter(F.col("disclosure") >= generalise).select("id", "term", "disclosure", (F.col("disclosure") >= remove).alias("removed"))


def _revealing(docs: DataFrame, **thresholds) -> DataFrame:
    """``key`` and the ``places`` (start, end, value, removed) of revealing terms in the text with that digest."""
    classed = Table(_classes(Table(mentions(docs)).rows)).rows
    flagged = disclosing_terms(docs, classed, **thresholds)
    pairs = classed.select("key", F.explode("classes.id").alias("id")).join(flagged, "id").groupBy("key", "term").agg(F.bool_or("removed").alias("removed"))
    pairs = Table(pairs).rows
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(broadcast_if_small(pairs.select("key").distinct()), "key", "left_semi")
    words = texts.dropDuplicates(["key"]).select("key", F.explode(_located(F.col("text"), TERM, lambda v: F.lit(True))).alias("at"))
    words = words.select("key", "at.*", F.lower("at.value").alias("term"))
    placed = words.join(pairs, ["key", "term"])
    return Table(placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value", "removed"))).alias("places"))).rows


def _clear_of(terms: Column, spans: Column) -> Column:
    """The terms that no span overlaps; one pass over both in order."""
    # A term stands at its end, a span at its start: the spans before a term are those that start inside or before it.
    ends = F.transform(terms, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("reach"), t.alias("term")))
    starts = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("kind"), s["end"].alias("reach"), F.lit(None).cast(TERM_SPAN).alias("term")))
    passed = _running(F.array_sort(F.concat(ends, starts)), lambda reach, x: F.greatest(reach, x["reach"]))
    fine = F.filter(passed, lambda p: (p["item"]["kind"] == 0) & (p["before"] <= p["item"]["term"]["start"]))
    return F.transform(fine, lambda p: p["item"]["term"])


def find_spans(docs: DataFrame, few_terms: int = FEW_TERMS, **thresholds) -> DataFrame:
    """Add the identifiers' spans by kind, and ``term``: spans (start, end, value) with ``removed``."""
    docs = docs.drop(*ADDED)
    columns = docs.columns
    revealing = _revealing(docs, **thresholds)
    n = revealing.agg(F.sum(F.size("places"))).first()[0] or 0
    side = F.broadcast(revealing) if n <= few_terms else revealing
    # The row travels as one column, so that no name of its own meets those used here.
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("body"))
    rows = rows.withColumn("own", text_key(F.col("body"))).join(side, F.col("own") == F.col("key"), "left").select("row", "body", "places")
    marked = identifiers(rows, "body")
    terms = F.when(F.col("places").isNotNull(), _clear_of(F.col("places"), F.concat(*KINDS))).otherwise(F.array().cast(f"array<{TERM_SPAN}>"))
    return marked.select("row.*", *KINDS, terms.alias("term"))


def span_list(*kinds: str) -> Column:
    """``kind:start:end`` of all spans, by kind and start, joined by commas."""
    text = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[text(k) for k in kinds]), ",")


def sanitised(text: Column) -> Column:
    """The text with identifiers and revealing terms replaced; needs the columns of ``find_spans``."""
    mark = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{k.upper()}>").alias("by")))
    term = F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(F.lit("<TERM>")).alias("by")))
    spans = F.array_sort(F.concat(*[mark(k) for k in KINDS], term))
    # Of overlapping spans the first one stands for all; the text goes on behind the last end.
    passed = _running(spans, lambda at, s: F.greatest(at, s["end"]))
    fresh = F.filter(passed, lambda p: p["item"]["start"] >= p["before"])
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    gaps = F.transform(fresh, lambda p: F.struct(p["before"].alias("from"), p["item"]["start"].alias("to"), p["item"]["by"].alias("by")))
    gaps = F.concat(gaps, F.array(F.struct(last.alias("from"), F.length(text).alias("to"), F.lit("").alias("by"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))

    def between(cuts: Column, gap: Column) -> Column:
        """The text of a gap, put together from the pieces it lies in."""
        first, final = F.floor(gap["from"] / _CUT).cast("int"), F.floor(F.greatest(gap["from"], gap["to"] - 1) / _CUT).cast("int")

        def part(i: Column) -> Column:
            low = F.greatest(gap["from"] - i * _CUT, F.lit(0))
            return F.coalesce(F.substring(F.get(cuts, i), low + 1, F.least(gap["to"] - i * _CUT, F.lit(_CUT)) - low), F.lit(""))

        return F.concat(F.array_join(F.transform(F.sequence(first, final), part), ""), gap["by"])

    joined = _let(pieces, lambda cuts: F.array_join(F.transform(gaps, lambda gap: between(cuts, gap)), ""))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
