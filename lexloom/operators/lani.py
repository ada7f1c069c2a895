"""Language of sentences from word frequencies, as a join and aggregates.

For a token that some languages know, with probabilities p that sum to S, a language that doesn't
know it gets ``rest = 0.1 * S / n`` for n languages. What all languages share cancels when scores are
normalised, so a language's score is the softmax of ``sum(ln(p / rest))`` over the tokens it knows;
logarithms can't overflow on long sentences. Tokens that no language knows count for none.
"""

from __future__ import annotations

import configparser
import logging
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
WORDLIST_SCHEMA = "lang string, word string, prob double"
#: Signs that are deleted from a sentence before it is split at single blanks.
SPECIAL_CHARS = r"[\]\[,.;:!?\"'()„“”«»|/\\]"
#: Languages that are always checked for, beside those near the wanted one.
ALWAYS = ("eng", "deu", "fra", "spa", "ita", "por", "rus")
MIN_COVERAGE, MIN_WORDS = 0.15, 2
#: Word-list entries up to which the list is broadcast.
BROADCAST_WORDS = 1_000_000


def read_wordlists(spark: SparkSession, folder: str | Path, languages: Iterable[str] | None = None) -> DataFrame:
    """Lists ``<lang>.words``: the corpus size, then ``count<TAB>word``; of repeated words the first."""
    folder = Path(folder)
    if not folder.is_dir():
        raise FileNotFoundError(f"no word-list folder {folder}")
    if any(folder.glob("*.ser.gz")):
        raise ValueError("serialised word lists aren't read; plain lists are")
    wanted = None if languages is None else set(languages)
    rows = []
    for path in sorted(folder.glob("*.words")):
        if wanted is not None and path.stem not in wanted:
            continue
        first, *rest = path.read_text(encoding="utf-8").split("\n")
        size = int(first.strip())
        if size <= 0:
            raise ValueError(f"{path}: the corpus size must be positive")
        seen = set()
        for line in rest:
            count, tab, word = line.rstrip("\r").partition("\t")
            if tab and word not in seen:
                seen.add(word)
                rows.append((path.stem, word, int(count) / size))
    if wanted is not None and wanted - {r[0] for r in rows}:
        raise ValueError(f"unknown languages: {sorted(wanted - {r[0] for r in rows})}")
    return spark.createDataFrame(rows, WORDLIST_SCHEMA)


def learn_wordlists(labelled: DataFrame, lang: str, text: str, size: int = 2000) -> DataFrame:
    """Word lists from labelled texts: the most frequent words of each language."""
    words = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.split(F.regexp_replace(text, r"[\n]", " "), " ")).alias("word")).where("word != ''")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("size"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= size)
    return ranked.join(F.broadcast(total), "lang").select("lang", "word", (F.col("n") / F.col("size")).alias("prob"))


def sentence_tokens(sentence: Column, special: str | None = SPECIAL_CHARS) -> Column:
    """Tokens of a sentence: split at single blanks, empty ones count."""
    return F.split(F.regexp_replace(sentence, special, "") if special else sentence, " ", -1)


def scores(sentences: DataFrame, wordlist: DataFrame, key: list[str], column: str = "sentence", filter_list: DataFrame | None = None, special: str | None = SPECIAL_CHARS, max_words: int | None = None, reduced: bool = False) -> DataFrame:
    """``key``, lang, score (0 to 1), and unless ``reduced`` coverage and wordcount, for every language.

    The word list is broadcast if it is small enough (its size is counted); otherwise the join is a
    shuffle on the word. ``filter_list`` has a column word of tokens to pass over."""
    langs = [r[0] for r in wordlist.select("lang").distinct().orderBy("lang").collect()]
    n = len(langs)
    listed = sentences.select(*key, sentence_tokens(F.col(column), special).alias("__tokens")).select(*key, F.size("__tokens").alias("n_tokens"), "__tokens")
    tokens = listed.select(*key, "n_tokens", F.posexplode("__tokens").alias("pos", "word"))
    lengths = listed.select(*key, "n_tokens")
    if max_words:  # every k-th token, up to so many
        step = F.greatest(F.lit(1), F.floor(F.col("n_tokens") / max_words).cast("int"))
        tokens = tokens.where((F.col("pos") % step == 0) & (F.col("pos") < step * max_words))
        lengths = lengths.withColumn("n_tokens", F.least(F.lit(max_words), F.ceil(F.col("n_tokens") / step).cast("int")))
    if filter_list is not None:
        tokens = tokens.join(F.broadcast(filter_list.select("word").distinct()), "word", "left_anti") if filter_list.count() <= BROADCAST_WORDS else tokens.join(filter_list, "word", "left_anti")
    # one row a word, with all its languages: a token joins once, and S is at hand
    words = wordlist.groupBy("word").agg(F.sum("prob").alias("s"), F.collect_list(F.struct("lang", "prob")).alias("found"))
    if wordlist.count() <= BROADCAST_WORDS:
        words = F.broadcast(words)
    hits = tokens.join(words, "word").select(*key, F.col("s"), F.explode("found").alias("f"))
    rest = F.lit(0.1) * F.col("s") / F.lit(float(n))
    sums = hits.groupBy(*key, F.col("f.lang").alias("lang")).agg(F.sum(F.log(F.col("f.prob") / rest)).alias("logit"), F.count(F.lit(1)).alias("wordcount"))
    grid = lengths.select(*key, "n_tokens", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
    full = grid.join(sums, [*key, "lang"], "left").withColumns({"logit": F.coalesce("logit", F.lit(0.0)), "wordcount": F.coalesce("wordcount", F.lit(0).cast("long"))})
    w = Window.partitionBy(*key)
    weight = F.exp(F.col("logit") - F.max("logit").over(w))
    out = full.withColumn("weight", weight).withColumn("score", F.col("weight") / F.sum("weight").over(w))
    if reduced:
        return out.select(*key, "lang", "score")
    return out.select(*key, "lang", "score", (F.col("wordcount") / F.col("n_tokens")).alias("coverage"), "wordcount")


def best(scored: DataFrame, key: list[str], min_coverage: float = MIN_COVERAGE, min_words: int = MIN_WORDS) -> DataFrame:
    """The two best languages with whole percentages (half to even), and what is known of the best.

    ``unknown`` with probability 0 where the best isn't twice as likely as the next, or knows too few
    of the words."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "lang")
    full = "coverage" in scored.columns
    top = scored.withColumn("r", F.row_number().over(w)).where("r <= 2")

    def of(c: str, r: int) -> Column:
        return F.max(F.when(F.col("r") == r, F.col(c)))

    extra = [of("wordcount", 1).alias("wordcount"), of("coverage", 1).alias("coverage")] if full else [F.lit(-1).cast("long").alias("wordcount"), F.lit(-1.0).alias("coverage")]
    two = top.groupBy(*key).agg(of("lang", 1).alias("l1"), of("lang", 2).alias("l2"), F.bround(of("score", 1) * 100).cast("int").alias("p1"), F.bround(F.coalesce(of("score", 2), F.lit(0.0)) * 100).cast("int").alias("p2"), *extra)
    unknown = F.col("p1") < 2 * F.col("p2")
    if full:
        unknown = unknown | ((F.col("wordcount") > 0) & (F.col("wordcount") < min_words)) | (F.col("coverage") < min_coverage)
    none = F.lit("unknown")
    return two.select(
        *key,
        F.when(unknown, none).otherwise(F.col("l1")).alias("language"),
        F.when(unknown, none).otherwise(F.col("l2")).alias("language_nextbest"),
        F.when(unknown, 0).otherwise(F.col("p1")).alias("probability"),
        F.when(unknown, 0).otherwise(F.col("p2")).alias("probability_nextbest"),
        "wordcount",
        "coverage",
    )


def similar_languages(distances: DataFrame, languages: DataFrame, threshold: float = 0.8) -> DataFrame:
    """lang, other: languages to check for with each of ``languages``: those at a distance below the
    threshold (``distances``: lang_1, a prefix of the name, lang_2, dist), those always checked, itself.
    """
    near = languages.join(F.broadcast(distances), F.expr("startswith(lang, lang_1)") & (F.col("dist") < threshold)).select("lang", F.col("lang_2").alias("other"))
    always = languages.select("lang", F.explode(F.array(*[F.lit(x) for x in ALWAYS])).alias("other"))
    return near.union(always).union(languages.select("lang", F.col("lang").alias("other"))).distinct()


def read_config(path: str | Path) -> dict[str, str]:
    """Settings of an ini file without sections; values that are relative paths start at its folder."""
    path = Path(path)
    parser = configparser.ConfigParser()
    parser.read_string("[all]\n" + path.read_text(encoding="utf-8"))
    out = dict(parser["all"])
    for k, v in out.items():
        if ("/" in v or v.endswith((".txt", ".list"))) and not Path(v).is_absolute():
            out[k] = str(path.parent / v)
            if not Path(out[k]).exists():
                LOG.warning("%s: %s doesn't exist", k, out[k])
    return out


def split_by_language(docs: DataFrame, wordlist: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """Each document's lines by language: ``key``, language, content (its lines in their order)."""
    from lexloom.functions.text import lines

    rows = docs.select(*key, F.posexplode(lines(F.col(content))).alias("sent_ord", "sentence"))
    result = best(scores(rows, wordlist, [*key, "sent_ord"]), [*key, "sent_ord"])
    joined = rows.join(result.select(*key, "sent_ord", "language"), [*key, "sent_ord"])
    label = F.when(F.col("sentence") == "", "unknown").otherwise(F.col("language"))
    nested = joined.groupBy(*key, label.alias("language")).agg(F.array_sort(F.collect_list(F.struct("sent_ord", "sentence"))).alias("s"))
    return nested.select(*key, "language", F.array_join(F.transform("s", lambda x: x["sentence"]), "\n").alias("content"))
