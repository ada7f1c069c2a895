"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base entities (e-mail, IP, card and phone) are found by their form, secrets by being long strings of
mixed letters and digits. They are the seeds: what stands around them (the two words before; the word
before and the one after) and their shape (digits as 0, runs of letters as a) are lexical patterns.
In the graph of patterns and the strings in their slots, a pattern's confidence for a kind is the
share of its strings that are known to be of that kind, and a string's score is that at least one of
its patterns is right. Patterns of enough confidence and known strings make their other strings
known, which support further patterns in the next round, until nothing is new. Strings with a score
are spans of that kind.

What a slot holds is a whole base entity, a run of identifier-like tokens (those with a digit or an at
sign; only tokens without letters join, as those of phones and cards do), or any other word. Runs are
marked wherever they stand, for the score that their patterns give them; words without digit or at
sign only in the slot of a confident pattern, and only if there is a sign between their letters: words
of letters alone count against a pattern, but are no identifiers.

Scale: texts are read once for the seeds and runs, which are a slim written table, and once a round in
which patterns are new, for the other words in their slots. All else is grouped by pattern or by
string with partial aggregation, so a pattern around a third of all tokens costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checked_join, drop, text_key, written

#: Kinds that base entities have.
KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans.
NAMES = (*KINDS, "secret")
#: Least share of a pattern's strings that must be known to be of the kind, and least score.
CONFIDENCE = 0.5
#: Least number of different known strings behind a pattern.
SUPPORT = 3

# Possessive forms that match what the plain greedy ones do: no class overlaps with what follows it.
# A search may start where the last match ended or where a run starts, so that long runs are linear.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_FORMS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: Without a match of this there is none of the form.
_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Words, and line breaks, which are words of their own.
_WORD = r"[^\x20\x09-\x0D]++|[\x0A-\x0D]"
#: Words with an entity in them; a search starts where a word does, so that long words are linear.
_MASKED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\x{e000}]*+\x{e000}[^\x20\x09-\x0D]*+"
#: Private signs: around the number of a base entity, which is one word or part of one; a line break.
_MASK, _BREAK = "\ue000", "\ue001"
_SECRET = r"^[^\p{L}\p{N}]*+(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}[^\p{L}\p{N}]*$"
_SPAN = "array<struct<start:int,k:int,end:int>>"
#: Matches whose offsets are added up at a time.
_STRETCH = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: what a lambda refers to outside of it would be
    worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(lengths: Column) -> Column:
    """Sums of all elements before each one; linear but for stretches of ``_STRETCH``."""
    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def added(parts: Column) -> Column:
        both = F.arrays_zip(parts.alias("p"), running(F.transform(parts, lambda p: p["at"]))["out"].alias("b"))
        return F.flatten(F.transform(both, lambda z: F.transform(z["p"]["out"], lambda x: x + z["b"])))

    def cut(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(xs)), F.lit(_STRETCH))
        return _let(F.transform(starts, lambda i: running(F.slice(xs, i, _STRETCH))), added)

    return _let(lengths, cut)


def _located(text: Column, pattern: str) -> Column:
    """array of struct(start, end, s) of all matches; code points, end exclusive."""
    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g))
        both = F.arrays_zip(gaps.alias("g"), found.alias("m"))
        return _let(both, lambda xs: ends(xs))

    def ends(xs: Column) -> Column:
        each = F.arrays_zip(xs.alias("x"), _before(F.transform(xs, lambda x: x["g"] + F.length(x["m"]))).alias("b"))
        return F.transform(each, lambda z: F.struct((z["b"] + z["x"]["g"]).alias("start"), (z["b"] + z["x"]["g"] + F.length(z["x"]["m"])).alias("end"), z["x"]["m"].alias("s")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        # leading zeros don't count; more than three digits are above 255
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        digits = F.regexp_replace(s, r"[^0-9]", "")
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(s, r"[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base entities of a text as array of struct(start, k, end), sorted; ``k`` is the kind's place."""
    none = F.from_json(F.lit("[]"), _SPAN)
    parts = []

    def of(k: int, kind: str) -> Column:
        found = F.filter(_located(text, _FORMS[kind]), lambda m: _valid(kind, m["s"]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))

    for k, kind in enumerate(KINDS):
        gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_GATES[kind])
        parts.append(F.when(gate, of(k, kind)).otherwise(none))
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*parts))).otherwise(none)


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(base: Column) -> Column:
    """Base spans that overlap put together, as array of struct(start, end)."""
    def put(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], b["end"]).alias("end")))
        return F.when((F.size(acc) > 0) & (b["start"] < last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), wider)).otherwise(F.concat(acc, F.array(F.struct(b["start"].alias("start"), b["end"].alias("end")))))

    return F.aggregate(base, F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>"), put)


def _masked(text: Column, apart: Column, sign) -> Column:
    """The text with ``sign(number, length)`` for its entities."""
    ends = F.concat(F.array(F.lit(0)), F.transform(apart, lambda b: b["end"]))

    def piece(z: Column, i: Column) -> Column:
        rest = F.substring(text, z["e"] + 1, F.length(text))
        return F.when(z["b"].isNull(), rest).otherwise(F.concat(F.substring(text, z["e"] + 1, z["b"]["start"] - z["e"]), sign(i, z["b"]["end"] - z["b"]["start"])))

    return F.when(F.size(apart) == 0, text).otherwise(F.array_join(F.transform(F.arrays_zip(ends.alias("e"), apart.alias("b")), piece), ""))


def _words(text: Column) -> Column:
    """An empty word, a line break, and then the words of a text, line breaks among them."""
    return F.split(F.regexp_replace(F.concat(F.lit("\n"), text), r"[\x0A\x0D]", f" {_BREAK} "), r"[\x20\x09-\x0D]+")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), text.alias("t"))


def _rows(texts: DataFrame) -> DataFrame:
    """id, text_key, t, base, apart and masked of all rows of ``_texts``, and what else they have."""
    rows = texts.withColumn("base", base_spans(F.col("t"))).withColumn("apart", _apart(F.col("base")))
    return rows.withColumn("masked", _masked(F.col("t"), F.col("apart"), lambda i, n: F.concat(F.lit(_MASK), i.cast("string"), F.lit(_MASK))))


def _contexts(masked: Column) -> Column:
    """The words as context: in lower case, digits as 0."""
    return _words(F.regexp_replace(F.lower(masked), "[1-9]", "0"))


def _around(i: Column) -> list[Column]:
    """l2, l1 and r1 of the word at a place of ``c``, the words as context; entities are all alike."""
    def at(d: int) -> Column:
        w = F.get(F.col("c"), i + d)
        return F.when(w.contains(_MASK), F.lit(_MASK)).otherwise(F.coalesce(w, F.lit("")))

    return [at(-2).alias("l2"), at(-1).alias("l1"), at(1).alias("r1")]


def _joined(before: Column, this: Column) -> Column:
    """Whether two tokens can be of one identifier: in a row, without letters."""
    bare = ~this["s"].rlike(r"[\p{L}@]") & ~before["s"].rlike(r"[\p{L}@]|[,;:.!?]$")
    return ~this["seeded"] & ~before["seeded"] & (this["i"] == before["i"] + 1) & bare


def _runs(tokens: Column) -> Column:
    """Longest runs of joined tokens, each as the array of its tokens.

    ``tokens`` has to be a plain column, for it is looked up by place."""
    n = F.size(tokens)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(places, lambda i: (i == 0) | ~F.coalesce(_joined(F.get(tokens, i - 1), F.get(tokens, i)), F.lit(False)))
    ends = F.concat(F.slice(heads, F.lit(2), F.greatest(F.size(heads), F.lit(1))), F.array(n))
    return F.transform(F.arrays_zip(heads.alias("h"), ends.alias("e")), lambda z: F.slice(tokens, z["h"] + 1, z["e"] - z["h"]))


def _own(s: Column) -> Column:
    """A string without the signs around it, in lower case."""
    bare = F.regexp_replace(F.lower(s), r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
    return F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " ")


def _shape(string: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(string, r"[0-9]", "0"), r"\p{L}+", "a")


def _patterns(x: Column, string: Column | None = None) -> Column:
    left = F.when((x["l1"] != "") & (x["l2"] != ""), F.concat_ws(" ", F.lit("l"), x["l2"], x["l1"]))
    around = F.when((x["l1"] != "") & (x["r1"] != ""), F.concat_ws(" ", F.lit("s"), x["l1"], F.lit("_"), x["r1"]))
    shape = [] if string is None else [F.concat_ws(" ", F.lit("h"), _shape(string))]
    return F.array_compact(F.array(left, around, *shape))


def _hash(kind: str, *words: Column) -> Column:
    return F.xxhash64(F.lit(kind), *words)


def _slots(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, i, string, pattern: words without digit or at sign in the slots of patterns.

    Every word is a row with the two hashes of what stands around it. Only those whose hash is that
    of a pattern are looked at further, and the patterns compared."""
    masked = F.when(F.col("masked").contains(_MASK), F.regexp_replace("masked", _MASKED, _MASK)).otherwise(F.col("masked"))
    rows = _rows(_texts(docs, id_col, text_col)).select("id", "text_key", masked.alias("masked")).select("id", "text_key", _contexts(F.col("masked")).alias("c"))
    shifted = [F.slice("c", k, F.size("c")).alias(name) for k, name in ((2, "l1"), (3, "s"), (4, "r1"))]
    # of an inner explode a filter is inferred, which is pushed below and splits the texts again
    words = rows.select("id", "text_key", F.posexplode_outer(F.arrays_zip(F.col("c").alias("l2"), *shifted)).alias("p", "x"))
    words = words.select("id", "text_key", (F.col("p") + 2).alias("i"), "x.*")
    words = words.withColumns({"left": _hash("l", F.col("l2"), F.col("l1")), "around": _hash("s", F.col("l1"), F.col("r1"))})
    parts = F.split("pattern", " ")
    left = _hash("l", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
    around = _hash("s", F.get(parts, F.lit(1)), F.get(parts, F.lit(3)))
    hashes = patterns.select(F.when(F.col("pattern").startswith("l "), left).otherwise(around).alias("h")).distinct()
    for name in ("left", "around"):
        words = checked_join(words, hashes.select(F.col("h").alias(name), F.lit(True).alias(f"is_{name}")), name)
    hit = F.coalesce(F.col("is_left"), F.col("is_around"))
    # words without digits read the same as context; what depends on ``hit`` isn't worked out for others
    found = words.where(F.when(hit, ~F.col("s").rlike(r"[0@\x{e000}\x{e001}]|^$")))
    each = found.select("id", "text_key", "i", F.when(hit, _own(F.col("s"))).alias("string"), F.explode(F.when(hit, _patterns(F.struct("l2", "l1", "r1")))).alias("pattern"))
    return checked_join(each.where("string != ''"), patterns.select("pattern").distinct(), "pattern", "inner")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """One row per document: id, base and spans (arrays of struct(start, k, end)), text_key.

    Null counts as empty and has no spans; words are whole, however long. Repeated rows have the same
    spans; strings at several places are spans at each. An empty table gives no rows."""
    rows = _rows(_texts(docs, id_col, text_col))
    focus = F.col("t").rlike("[0-9@]")
    rows = rows.withColumns({"w": F.when(focus, _words(F.col("masked"))), "c": F.when(focus, _contexts(F.col("masked")))})
    places = F.filter(F.transform("c", lambda x, i: F.when(x.rlike(r"[0@\x{e000}]"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places)

    def context(i: Column) -> Column:
        w = F.get(F.col("w"), i)
        return F.struct(i.alias("i"), w.alias("s"), w.contains(_MASK).alias("seeded"), *_around(i))

    rows = rows.withColumn("tokens", F.transform("places", context))

    def entities_in(x: Column) -> Column:
        numbers = F.regexp_extract_all(x["s"], F.lit(f"{_MASK}([0-9]+){_MASK}"), F.lit(1))
        spans = F.transform(numbers, lambda j: F.get(F.col("apart"), j.cast("int")))
        own = F.filter(F.col("base"), lambda b: F.exists(spans, lambda a: (b["start"] < a["end"]) & (b["end"] > a["start"])))
        return F.transform(own, lambda b: F.struct(b["k"].alias("k"), F.substring(F.col("t"), b["start"] + 1, b["end"] - b["start"]).alias("s"), x["l2"].alias("l2"), x["l1"].alias("l1"), x["r1"].alias("r1")))

    rows = rows.withColumn("entities", F.flatten(F.transform(F.filter("tokens", lambda x: x["seeded"]), entities_in)))
    rows = written(rows.select("id", "text_key", "base", "tokens", "entities"), "pii")
    runs = written(rows.where(F.size("tokens") > 0).select("id", "text_key", F.explode(_runs(F.col("tokens"))).alias("run")).where(~F.get("run", F.lit(0))["seeded"]), "pii-runs")
    first, last = F.get("run", F.lit(0)), F.element_at("run", -1)
    raw = F.array_join(F.transform("run", lambda x: x["s"]), " ")
    whole = F.struct(_own(raw).alias("s"), first["l2"].alias("l2"), first["l1"].alias("l1"), last["r1"].alias("r1"))
    secret = F.when((F.size("run") == 1) & raw.rlike(_SECRET), F.lit(NAMES.index("secret")))
    entities = rows.select(F.explode("entities").alias("x")).select(_own(F.col("x.s")).alias("string"), F.col("x.k").alias("seed"), _patterns(F.col("x"), _own(F.col("x.s"))).alias("patterns"))
    others = runs.select(whole.alias("x"), secret.alias("seed")).select(F.col("x.s").alias("string"), "seed", _patterns(F.col("x"), F.col("x.s")).alias("patterns"))
    instances = written(entities.unionByName(others).where("string != ''"), "pii-instances")
    edges = written(instances.select(F.explode("patterns").alias("pattern"), "string").distinct(), "pii-edges")
    seeds = written(instances.where("seed is not null").groupBy("string").agg(F.min("seed").alias("k")), "pii-known")

    known, n_known, best, scanned, slots = seeds, seeds.count(), None, None, None
    while True:
        backed = checked_join(edges, known, "string", "inner").groupBy("pattern", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
        degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree"))
        scored = checked_join(degree, written(backed, "pii-backed"), "pattern", "inner").withColumn("conf", F.col("n") / F.col("degree")).where(F.col("conf") >= confidence)
        patterns = written(scored.select("pattern", "k", "conf"), "pii-patterns")
        fresh = patterns.where(~F.col("pattern").startswith("h ")).select("pattern").distinct()
        if scanned is not None:
            fresh = checked_join(fresh, scanned, "pattern", "left_anti")
        fresh = written(fresh, "pii-fresh")
        if not fresh.isEmpty():
            # what else is in these slots lowers the confidence, or is found
            more = _slots(docs, fresh, id_col, text_col)
            slots = written(more if slots is None else slots.unionByName(more), "pii-slots")
            edges = written(edges.unionByName(slots.select("pattern", "string")).distinct(), "pii-edges")
            scanned = written(fresh if scanned is None else scanned.unionByName(fresh), "pii-scanned")
            continue
        # a string's score: one less the chance that all of its patterns are wrong
        miss = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))))
        strings = checked_join(edges, patterns, "pattern", "inner").groupBy("string", "k").agg((1 - miss).alias("score")).where(F.col("score") >= confidence)
        strings = strings.where(F.col("string").rlike(r"[^\p{L}]"))  # plain words count in slots, but are no identifiers
        top = strings.groupBy("string").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("k").alias("k"))).alias("b")).select("string", F.col("b.k").alias("k"))
        if best is not None:
            drop(best)
        best = written(top, "pii-best")
        # a string stays of the kind that it was first known as
        known = written(known.unionByName(checked_join(best, known.select("string"), "string", "left_anti")), "pii-known")
        n = known.count()
        if n == n_known:
            break
        n_known = n

    # runs are marked elsewhere too: any joined tokens whose string has a score, or that are a secret
    size, words = F.size("run"), best.agg(F.max(F.size(F.split("string", " ")))).first()[0] or 1
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(max(1, words)), size - i + 1)),
                lambda m: F.struct(F.get("run", i - 1)["i"].alias("i"), F.get("run", i + m - 2)["i"].alias("j"), F.array_join(F.transform(F.slice("run", i, m), lambda x: x["s"]), " ").alias("s")),
            ),
        )
    )
    places = runs.select("id", "text_key", F.explode(parts).alias("x")).select("id", "text_key", "x.i", "x.j", _own(F.col("x.s")).alias("string"))
    marks = checked_join(places, best, "string", "inner").select("id", "text_key", "i", "j", "k")
    marks = marks.unionByName(runs.where(secret.isNotNull()).select("id", "text_key", first["i"].alias("i"), first["i"].alias("j"), secret.alias("k")))
    if slots is not None:
        good = checked_join(slots, patterns.select("pattern").distinct(), "pattern", "inner")
        marks = marks.unionByName(checked_join(good, best, "string", "inner").select("id", "text_key", "i", F.col("i").alias("j"), "k"))
    marks = marks.groupBy(F.col("id").alias("m_id"), F.col("text_key").alias("m_key")).agg(F.collect_set(F.struct("i", "j", "k")).alias("m"))
    marks = written(marks, "pii-marks")
    # only in texts with marks the places of words are worked out
    texts = _rows(checked_join(_texts(docs, id_col, text_col), marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "inner"))
    same = _masked(F.col("t"), F.col("apart"), lambda i, n: F.repeat(F.lit(_MASK), n))
    texts = texts.select("id", "text_key", "m", same.alias("masked")).withColumn("w", _located(F.col("masked"), _WORD))
    place = lambda i: F.get(F.col("w"), i - 2)  # noqa: E731  an empty word and a line break stand before the text
    marked = texts.select("id", "text_key", F.explode(F.transform("m", lambda x: F.struct(place(x["i"])["start"].alias("start"), x["k"].alias("k"), place(x["j"])["end"].alias("end")))).alias("span"))
    added = marked.groupBy("id", "text_key").agg(F.collect_set("span").alias("added"))
    # of spans of a kind within each other the longest stays
    added = added.withColumn("added", F.filter("added", lambda x: ~F.exists("added", lambda y: (y["k"] == x["k"]) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"]))))
    added = written(added.select(F.col("id").alias("a_id"), F.col("text_key").alias("a_key"), "added"), "pii-added")
    out = checked_join(rows.select("id", "text_key", "base"), added, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key")))
    spans = F.array_sort(F.array_union("base", F.coalesce("added", F.from_json(F.lit("[]"), _SPAN))))
    return out.select(F.col("id").alias(id_col), "base", spans.alias("spans"), "text_key")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, all spans as text, and the number of these."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(_line(F.col("base")).cast("binary"), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
