"""DuckDB statements for the registered queries."""

from __future__ import annotations

from lexloom.operators import cleaner, lani

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_DAY = "strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d')"
_DOCS = f"docs AS (SELECT doc_id, source AS location, {_DAY} AS date, text AS content, lang FROM documents)"


def _split(column: str) -> str:
    """Lines of a text, without the empty one after a final break."""
    parts = f"regexp_split_to_array({column}, '{_BREAK}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


_LINES = f"""{_DOCS},
    parts AS (SELECT doc_id, location, date, lang, {_split("content")} AS ls FROM docs),
    lines AS (SELECT doc_id, location, date, lang, unnest(ls) AS sentence, (generate_subscripts(ls, 1) - 1)::BIGINT AS sent_ord FROM parts)
"""
_TOKENS = rf"""{_LINES},
    tok AS (SELECT *, doc_id * 1000000 + sent_ord AS sent_id, regexp_extract_all(sentence, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]') AS ts FROM lines WHERE sentence <> ''),
    words AS (SELECT sent_id, unnest(ts) AS word, (generate_subscripts(ts, 1) - 1)::BIGINT AS pos FROM tok),
    freq AS (SELECT word, count(*)::BIGINT AS freq FROM words GROUP BY word),
    nums AS (SELECT (row_number() OVER (ORDER BY freq DESC, word))::BIGINT AS word_id, word, freq FROM freq)
"""
_KNOWN = "known(known_id, word) AS (VALUES (1, '.'), (2, ','), (3, 'the'), (4, '!'), (7, '?'), (9, 'de'), (12, 'unseen'))"
_SOURCES = "sources AS (SELECT (row_number() OVER (ORDER BY n DESC, date, source))::BIGINT AS source_id, source, date, n FROM (SELECT location AS source, date, count(*)::BIGINT AS n FROM tok GROUP BY ALL))"


def _rejects(rules: list[cleaner.Rule], s: str = "sentence") -> str:
    return " OR ".join(r.sql(s) for r in rules)


def _first(rules: list[cleaner.Rule], s: str = "sentence") -> str:
    return "CASE " + " ".join(f"WHEN {r.sql(s)} THEN {r.number}" for r in rules) + " END"


def _all(rules: list[cleaner.Rule], s: str = "sentence") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {r.sql(s)} THEN {r.number} END" for r in rules) + "], lambda x: x IS NOT NULL)"


_GENERAL = cleaner.load_rules()
_FAS = cleaner.load_rules(text_type="web", lang_code="fas")
_WEB = cleaner.load_rules(text_type="web")


def _replace(column: str) -> str:
    out = column
    for old, new in cleaner.load_replacements():
        quoted = [x.replace("'", "''") for x in (old, new)]
        out = f"replace({out}, '{quoted[0]}', '{quoted[1]}')"
    return out


def _wordlist(size: int) -> str:
    return f"""
    wl_words AS (SELECT lang, unnest(string_split(regexp_replace(text, '\\n', ' ', 'g'), ' ')) AS word FROM documents WHERE lang IS NOT NULL),
    wl_counts AS (SELECT lang, word, count(*) AS n FROM wl_words WHERE word <> '' GROUP BY ALL),
    wl_total AS (SELECT lang, sum(n) AS size FROM wl_counts GROUP BY lang),
    wl AS (SELECT lang, word, n / size::DOUBLE AS prob FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM wl_counts) JOIN wl_total USING (lang) WHERE r <= {size})"""


def _lani(rows: str = "SELECT doc_id, sent_ord, sentence, lang AS truth FROM lines WHERE sentence <> ''", limit: int | None = None) -> str:
    special = lani.SPECIAL_CHARS.replace("'", "''")
    tokens = f"string_split(regexp_replace(sentence, '{special}', '', 'g'), ' ')"
    if limit:
        step = f"greatest(1, floor(len({tokens}) / {limit})::INTEGER)"
        tokens = f"(list_filter({tokens}, lambda t, i: (i - 1) % {step} = 0))[1:{limit}]"
    return f"""{_LINES}, {_wordlist(2000)},
    n AS (SELECT count(DISTINCT lang) AS n FROM wl),
    base AS ({rows}),
    toks AS (SELECT doc_id, sent_ord, {tokens} AS ts FROM base),
    each AS (SELECT doc_id, sent_ord, unnest(ts) AS word FROM toks),
    mass AS (SELECT word, sum(prob) AS s FROM wl GROUP BY word),
    hits AS (SELECT doc_id, sent_ord, wl.lang, sum(ln(prob / (0.1 * s / n.n))) AS logit, count(*)::BIGINT AS wordcount
             FROM each JOIN wl USING (word) JOIN mass USING (word), n GROUP BY ALL),
    grid AS (SELECT doc_id, sent_ord, len(ts) AS n_tokens, l.lang FROM toks, (SELECT DISTINCT lang FROM wl) l),
    joined AS (SELECT g.*, coalesce(logit, 0.0) AS logit, coalesce(wordcount, 0)::BIGINT AS wordcount FROM grid g LEFT JOIN hits h USING (doc_id, sent_ord, lang)),
    weights AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY doc_id, sent_ord)) AS w FROM joined),
    scores AS (SELECT doc_id, sent_ord, lang, w / sum(w) OVER (PARTITION BY doc_id, sent_ord) AS score, wordcount / n_tokens::DOUBLE AS coverage, wordcount FROM weights)"""


def _best(full: bool = True) -> str:
    more = "OR (wordcount > 0 AND wordcount < 2) OR coverage < 0.15" if full else ""
    return f""",
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_ord ORDER BY score DESC, lang) AS r FROM scores),
    two AS (SELECT doc_id, sent_ord, max(lang) FILTER (r = 1) AS l1, max(wordcount) FILTER (r = 1) AS wordcount, max(coverage) FILTER (r = 1) AS coverage,
                   round_even(max(score) FILTER (r = 1) * 100, 0)::INTEGER AS p1, round_even(coalesce(max(score) FILTER (r = 2), 0) * 100, 0)::INTEGER AS p2
            FROM ranked WHERE r <= 2 GROUP BY ALL),
    best AS (SELECT *, (p1 < 2 * p2 {more}) AS unknown FROM two),
    labelled AS (SELECT doc_id, sent_ord, CASE WHEN unknown THEN 'unknown' ELSE l1 END AS language, CASE WHEN unknown THEN 0 ELSE p1 END AS probability, wordcount FROM best)"""


_PLAIN = r"list_filter(list_transform(regexp_extract_all({0} || chr(10), '[^.!?\n]*[.!?\n]'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"
def _rolling(xs: str, start: str, weight: int) -> str:
    return f"list_reduce(list_prepend({start}, {xs}), lambda h, x: ((h * {weight} + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


#: The rolling hash of a list of units ``xs``: the first 15, then a stride of the others.
_HASH = f"abs({_rolling('list_transform(range(16, len(xs) + 1, greatest(1, len(xs) // 16)), lambda p: xs[p])', _rolling('xs[1:15]', '0::BIGINT', 37), 39)})::BIGINT"
_UNITS = "CASE WHEN sentence = '' THEN []::BIGINT[] ELSE list_transform(range(1, length(sentence) + 1), lambda i: unicode(sentence[i])::BIGINT) END"
_BYTES = "list_transform(range(1, length(hex(encode(word))), 2), lambda i: CASE WHEN hex(encode(word))[i] >= '8' THEN ('0x' || hex(encode(word))[i : i + 1])::BIGINT - 256 ELSE ('0x' || hex(encode(word))[i : i + 1])::BIGINT END)"
_SIGNATURE = "CASE WHEN length(t) < 4 THEN t WHEN length(t) - 3 <= 32 THEN '456789abcdefghijklmnopqrstuvwxyz'[length(t) - 3] ELSE '0' END"

ORACLES: dict[str, str] = {
    "lines_flatten": f"WITH {_LINES} SELECT doc_id, sent_ord, sentence FROM lines",
    "lines_renest": f"WITH {_LINES} SELECT doc_id, string_agg(sentence, chr(10) ORDER BY sent_ord) AS content FROM lines GROUP BY doc_id",
    "medusa_rows": f"WITH {_LINES} SELECT doc_id, sent_ord, translate(sentence, chr(9) || chr(10) || chr(13), '   ') || chr(9) || date || chr(9) || location AS line FROM lines WHERE sentence <> ''",
    "jsonl_doc": f"WITH {_DOCS} SELECT doc_id, location, date, content FROM docs",
    "jsonl_sentences": f"WITH {_LINES} SELECT doc_id, location, date, count(*)::BIGINT AS n, string_agg(sentence, chr(10) ORDER BY sent_ord) AS joined FROM lines GROUP BY ALL",
    "source_text_rows": f"WITH {_DOCS} SELECT doc_id, '<source><location>' || location || '</location><date>' || date || '</date></source>' || chr(10) || regexp_replace(content, '\\n$', '') AS doc FROM docs",
    "source_headers": f"WITH {_LINES} SELECT header, count(*)::BIGINT AS n FROM (SELECT true AS header FROM docs UNION ALL SELECT false FROM lines) GROUP BY header",
    "clean_survivors": f"WITH {_LINES} SELECT location, count(*)::BIGINT AS n, sum(length(sentence))::BIGINT AS chars FROM lines WHERE sentence <> '' AND NOT ({_rejects(_GENERAL)}) GROUP BY location",
    "clean_first_rule": f"WITH {_LINES} SELECT doc_id, sent_ord, {_first(_GENERAL)} AS rule FROM lines",
    "clean_rule_hits": f"WITH {_LINES} SELECT rule, count(*)::BIGINT AS hits FROM (SELECT unnest({_all(_GENERAL)}) AS rule FROM lines) GROUP BY rule",
    "clean_first_rule_hits": f"WITH {_LINES} SELECT rule, count(*)::BIGINT AS hits FROM (SELECT {_first(_GENERAL)} AS rule FROM lines) WHERE rule IS NOT NULL GROUP BY rule",
    "clean_reasons_array": f"WITH {_LINES} SELECT doc_id, sent_ord, array_to_string({_all(_GENERAL)}, ' ') AS reasons FROM lines WHERE sentence <> ''",
    "clean_layered_override": f"WITH {_LINES} SELECT location, count(*)::BIGINT AS n, max(length(sentence))::BIGINT AS longest FROM lines WHERE sentence <> '' AND NOT ({_rejects(_FAS)}) GROUP BY location",
    "clean_nested": f"""WITH {_LINES}, kept AS (SELECT doc_id, sent_ord, sentence FROM lines WHERE sentence <> '' AND NOT ({_rejects(_GENERAL)}))
        SELECT d.doc_id, count(sentence)::BIGINT AS n, string_agg(sentence, chr(10) ORDER BY sent_ord) AS content FROM docs d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id""",
    "clean_conversations": f"WITH l AS (SELECT role, unnest({_split('text')}) AS sentence FROM conversations) SELECT role, count(*)::BIGINT AS n FROM l WHERE sentence <> '' AND NOT ({_rejects(_GENERAL)}) GROUP BY role",
    "page_web_rules": f"WITH l AS (SELECT unnest({_split('html')}) AS sentence FROM pages) SELECT rule, count(*)::BIGINT AS hits FROM (SELECT unnest({_all(_WEB)}) AS rule FROM l) GROUP BY rule",
    "replace_entities": f"SELECT page_id, {_replace('html')} AS html FROM pages",
    "annotate_filtered": f"WITH {_LINES} SELECT r > 0 AS filtered, count(*)::BIGINT AS n, sum(r)::BIGINT AS reasons FROM (SELECT len({_all(_GENERAL)}) AS r FROM lines WHERE sentence <> '') GROUP BY ALL",
    "doc_stats": rf"""WITH {_DOCS}, x AS (SELECT *, regexp_split_to_array(content, '\r\n|[\n\r]') AS ls, len(regexp_extract_all(content, '[^\x09-\x0d\x20]+')) AS toks FROM docs)
        SELECT count(*)::BIGINT AS docs, sum(len(ls) - (ls[-1] = '')::INTEGER)::BIGINT AS lines, sum(toks)::BIGINT AS tokens, sum(length(content))::BIGINT AS chars,
               count(DISTINCT coalesce(location, ''))::BIGINT AS sources, (count(DISTINCT date) + max((date IS NULL)::INTEGER))::BIGINT AS dates, count(DISTINCT coalesce(location, '') || coalesce(date, ''))::BIGINT AS source_dates FROM x""",
    "doc_stats_by_source": rf"""WITH {_DOCS}, x AS (SELECT *, regexp_split_to_array(content, '\r\n|[\n\r]') AS ls, len(regexp_extract_all(content, '[^\x09-\x0d\x20]+')) AS toks FROM docs)
        SELECT location, count(*)::BIGINT AS docs, sum(len(ls) - (ls[-1] = '')::INTEGER)::BIGINT AS lines, sum(toks)::BIGINT AS tokens, sum(length(content))::BIGINT AS chars, count(DISTINCT date)::BIGINT AS dates FROM x GROUP BY location""",
    "sentence_stats": rf"WITH {_LINES} SELECT count(DISTINCT location)::BIGINT AS sources, count(*)::BIGINT AS lines, sum(len(regexp_extract_all(sentence, '[^\s]+')))::BIGINT AS tokens, sum(length(sentence))::BIGINT AS chars FROM lines",
    "word_freq": f"WITH {_TOKENS} SELECT word, freq FROM freq",
    "word_numbers": f"WITH {_TOKENS} SELECT word_id, word, freq FROM nums",
    "source_numbers": f"WITH {_TOKENS}, {_SOURCES} SELECT source_id, source, date, n FROM sources",
    "known_word_remap": f"""WITH {_TOKENS}, {_KNOWN}, j AS (SELECT * FROM nums LEFT JOIN known USING (word))
        SELECT known_id::BIGINT AS word_nr, word, length(word)::BIGINT AS len, freq, word_id FROM j WHERE known_id IS NOT NULL
        UNION ALL SELECT (12 + row_number() OVER (ORDER BY freq DESC, word, word_id))::BIGINT, word, length(word)::BIGINT, freq, word_id FROM j WHERE known_id IS NULL""",
    "word_catalog": f"""WITH {_TOKENS}, {_KNOWN}, j AS (SELECT word, known_id, coalesce(freq, 0)::BIGINT AS freq, word_id FROM nums FULL JOIN known USING (word))
        SELECT known_id::BIGINT AS word_nr, word, length(word)::BIGINT AS len, freq FROM j WHERE known_id IS NOT NULL
        UNION ALL SELECT (12 + row_number() OVER (ORDER BY freq DESC, word, word_id))::BIGINT, word, length(word)::BIGINT, freq FROM j WHERE known_id IS NULL""",
    "sentence_index": f"""WITH {_TOKENS}, {_SOURCES}, ids AS (SELECT sent_id, string_agg(word_id::VARCHAR, ' ' ORDER BY pos) AS ids FROM words JOIN nums USING (word) GROUP BY sent_id)
        SELECT sent_id, source_id, (epoch(tok.date::DATE)::BIGINT // 60)::INTEGER AS ts_min, coalesce(ids, '') AS word_ids
        FROM tok JOIN sources ON tok.location = sources.source AND tok.date = sources.date LEFT JOIN ids USING (sent_id)""",
    "word_length_signature": f"WITH {_TOKENS} SELECT sent_id, array_to_string(list_transform(ts, lambda t: {_SIGNATURE}), '') AS signature FROM tok",
    "bucket_hash": f"WITH {_TOKENS}, u AS (SELECT word, {_BYTES} AS xs FROM freq) SELECT word, {_HASH} AS bucket FROM u",
    "string_hash": f"WITH {_LINES}, u AS (SELECT doc_id, sent_ord, {_UNITS} AS xs FROM lines) SELECT doc_id, sent_ord, {_HASH} AS hash FROM u",
    "mwu_count": f"""WITH {_TOKENS}, u(unit, n) AS (VALUES ('of the', 2), ('in the', 2), ('de la', 2), ('and the of', 3), ('la de la', 3)),
        g AS (SELECT ts, unit, n, unnest(range(0, greatest(0, len(ts) - n + 1))) AS pos FROM tok, u)
        SELECT unit, count(*)::BIGINT AS n, sum(pos)::BIGINT AS pos_sum FROM g WHERE array_to_string(ts[pos + 1 : pos + n], ' ') = unit GROUP BY unit""",
    "number_tokens": rf"WITH {_TOKENS} SELECT regexp_matches(word, '^[\p{{Nd}}\p{{Po}}-]+$') AS number, count(*)::BIGINT AS n FROM words GROUP BY ALL",
    "lani_wordlist": f"WITH {_wordlist(300)} SELECT lang, word, round(prob, 12) AS prob FROM wl",
    "lani_scores": f"WITH {_lani()} SELECT doc_id, sent_ord, lang, round(score, 6) AS score, wordcount FROM scores",
    "lani_best": f"WITH {_lani()}{_best()} SELECT doc_id, sent_ord, language, probability, wordcount FROM labelled",
    "lani_coverage": f"WITH {_lani()} SELECT lang, round(avg(coverage), 6) AS coverage, sum(wordcount)::BIGINT AS wordcount FROM scores GROUP BY lang",
    "lani_confusion": f"WITH {_lani()}{_best()} SELECT truth AS lang, language, count(*)::BIGINT AS n FROM base JOIN labelled USING (doc_id, sent_ord) GROUP BY ALL",
    "lani_sampled": f"WITH {_lani(limit=10)} SELECT lang, sum(wordcount)::BIGINT AS wordcount, round(sum(score), 4) AS score FROM scores GROUP BY lang",
    "lani_reduced": f"WITH {_lani()}{_best(False)} SELECT language, count(*)::BIGINT AS n FROM labelled GROUP BY language",
    "language_split_counts": f"""WITH {_lani("SELECT doc_id, sent_ord, sentence, lang AS truth FROM lines")}{_best()},
        d AS (SELECT doc_id, CASE WHEN sentence = '' THEN 'unknown' ELSE language END AS language, sum(length(sentence)) + count(*) - 1 AS chars FROM base JOIN labelled USING (doc_id, sent_ord) GROUP BY ALL)
        SELECT language, count(*)::BIGINT AS docs, sum(chars)::BIGINT AS chars FROM d GROUP BY language""",
    "similar_languages": """WITH l AS (SELECT DISTINCT lang FROM documents), d(lang_1, lang_2, dist) AS (VALUES ('de', 'nl', 0.5), ('de', 'en', 0.9), ('es', 'pt', 0.3), ('e', 'la', 0.7))
        SELECT lang, lang_2 AS other FROM l JOIN d ON starts_with(lang, lang_1) AND dist < 0.8
        UNION SELECT lang, unnest(['eng', 'deu', 'fra', 'spa', 'ita', 'por', 'rus']) FROM l UNION SELECT lang, lang FROM l""",
    "segment_plain": f"WITH x AS (SELECT doc_id, {_PLAIN.format('text')} AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, array_to_string(s, chr(10)) AS sentences FROM x",
    "conversation_segments": f"SELECT conv_id, turn, len({_PLAIN.format('text')})::BIGINT AS n FROM conversations",
    "tokenize_simple": f"WITH {_TOKENS} SELECT sent_id, array_to_string(ts, ' ') AS tokenized FROM tok",
    "align_glue": rf"""WITH {_TOKENS}, p AS (SELECT sent_id, ts, regexp_split_to_array(sentence, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]') AS gaps FROM tok WHERE len(ts) > 0)
        SELECT sent_id, array_to_string(list_transform(gaps[2 : len(ts)], lambda g: CASE WHEN g = '' THEN '1' ELSE '0' END), '') AS glue FROM p""",
    "token_structs": rf"""WITH {_TOKENS}, p AS (SELECT sent_id, sentence, ts, regexp_split_to_array(sentence, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]') AS gaps FROM tok WHERE len(ts) > 0)
        SELECT sent_id, len(list_filter(gaps[2 : len(ts)], lambda g: g <> ''))::BIGINT AS spaces, (length(sentence) - length(gaps[-1]) - length(ts[-1]))::BIGINT AS last_start, 1::BIGINT AS starts FROM p""",
    "slice_docs": "SELECT doc_id, strlen(text)::BIGINT AS length FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r BETWEEN 11 AND 60",
    "split_by_docs": "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 37 + 1)::BIGINT AS part FROM documents",
    "split_by_bytes": """WITH RECURSIVE o AS (SELECT doc_id, strlen(text)::BIGINT AS n, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
        f AS (SELECT doc_id, r, 1::BIGINT AS part, n AS used FROM o WHERE r = 1
              UNION ALL SELECT o.doc_id, o.r, CASE WHEN f.used + o.n > 50000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.used + o.n > 50000 THEN o.n ELSE f.used + o.n END FROM f JOIN o ON o.r = f.r + 1)
        SELECT doc_id, part FROM f""",
    "merge_docs": """WITH a AS (SELECT 'a' AS path, doc_id AS doc_ord FROM documents UNION ALL SELECT 'b', page_id FROM pages)
        SELECT path, doc_ord, (row_number() OVER (ORDER BY path, doc_ord))::BIGINT AS merged_ord FROM a""",
    "top_sources": f"""WITH {_LINES}, c AS (SELECT lang, location, count(*)::BIGINT AS n FROM lines GROUP BY ALL)
        SELECT lang, location, n, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, location) AS rank FROM c) WHERE rank <= 2""",
}

_STATS = ORACLES["doc_stats"]
ORACLES["doc_stats_tsv"] = f"""SELECT array_to_string(list_transform([docs, lines, tokens, chars, sources, dates, source_dates], lambda x: CASE WHEN x = 0 THEN '' ELSE x::VARCHAR END), chr(9)) AS line FROM ({_STATS})"""
