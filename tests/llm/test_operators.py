"""The ten operators against brute force, on hand-made rows and on the small tables."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import dropwhile
from math import log, log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import common, decontaminate, exact_dedup, language, lm_scoring, mixing, pii, sharding, simhash, tokens, toxicity
from lexloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, id string, start string, words string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    full = [(i, t, lang, src, None if t is None else len(t), "x", "y", "z", "s", "w") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, "Hello there, general world of words", "en", "a"),
    (1, "Hello there, general world of words", "en", "a"),
    (2, "hello\tthere,\ngeneral world of WORDS", "en", None),
    (3, None, None, "b"),
    (4, "", "en", "b"),
    (None, "no id at all here", "en", "c"),
    (5, " \t\n ", None, "c"),
    (6, "x" * 30000, "en", "a"),
    (7, "word " * 20000, "en", "a"),
    (8, "Ünïcödé ẞtraße İstanbul \U0001f600 日本語", "de", "b"),
    (9, "Hello there, general world of words", "en", "a"),
]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def blank_words(text):
    return [w for w in BLANK.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def docs_rows(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents(spark).collect()]


# language


def test_language_held_out(spark):
    rows = as_dicts(QUERIES["op1_language_profiles"](spark, "/root/testdata/sf0.01"))
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_awkward(spark):
    docs = frame(spark, AWKWARD)
    profiles = language.fit_profiles(docs)
    rows = as_dicts(language.identify(docs, profiles))
    assert len(rows) == len(AWKWARD)
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert got[3] == got[4] == got[5] == "und" and got[8] == "de" and got[1] == "en"
    assert language.identify(docs.limit(0), profiles).count() == 0
    assert {r["lang_pred"] for r in as_dicts(language.identify(docs, language.fit_profiles(docs.limit(0))))} == {"und"}


def test_language_counts_by_pieces(monkeypatch):
    text = "The quick brown fox; äöü 123 jumps. " * 50
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "PIECE", 40)
    parts = language.ngram_counts(text)
    gap = 2 << 60  # blanks alone
    pick = lambda x: {g: n for g, n in zip(*map(list, x)) if g != gap}
    assert pick(whole) == pick(parts)


def test_out_of_place_distance():
    p = language.Profiles({"a": np.array([1, 2, 3]), "b": np.array([3, 2, 9])}, size=4)
    # a: 3 is off by 2, 7 missing costs 4; b: 3 in place, 7 missing costs 4
    assert p.distances(np.array([3, 7])).tolist() == [6 / 8, 4 / 8]


# sharding


def test_curve_visits_neighbours(spark):
    side = 8
    cells = spark.range(side**3).select((F.col("id") % side).cast("int").alias("x"), (F.floor(F.col("id") / side) % side).cast("int").alias("y"), F.floor(F.col("id") / side**2).cast("int").alias("z"))
    rows = cells.select("x", "y", "z", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).collect()
    way = sorted((r["h"], (r["x"], r["y"], r["z"])) for r in rows)
    assert [h for h, _ in way] == list(range(side**3))
    assert all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for (_, a), (_, b) in zip(way, way[1:]))


@pytest.mark.parametrize("block_rows", [50_000, 7])
def test_shards(spark, block_rows):
    for docs in (documents(spark), frame(spark, AWKWARD)):
        rows = as_dicts(sharding.shard_hilbert(docs, block_rows=block_rows))
        want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 16, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in docs.collect())
        assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == [tuple(w) for w in want] if all(w[2] is not None for w in want) else len(rows) == len(want)
        shards = defaultdict(list)
        for r in rows:
            shards[r["shard"]].append(r)
        assert all(0 <= s < 40 for s in shards)
        total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        for s in range(40):
            assert sorted(r["slot"] for r in shards[s]) == list(range(len(shards[s])))
            assert abs(sum(r["size"] for r in shards[s]) - total / 40) <= largest
        by_shard = [sorted({r["cell"] for r in shards[s]}) for s in sorted(shards) if shards[s]]
        assert all(a[-1] <= b[0] for a, b in zip(by_shard, by_shard[1:]))  # runs of the curve


def test_shards_empty(spark):
    assert sharding.shard_hilbert(documents(spark).limit(0)).count() == 0


# mixing


def water(sizes, weights, most=3.0):
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes) else (lo, mid)
    return [min(most * s, hi * w) for s, w in zip(sizes, weights)]


def test_budgets():
    sizes = {"b": 1000, "a": 10, None: 500, "c": 0, "d": 3}
    got = mixing.budgets(sizes)
    order = ["a", "b", "c", "d", None]
    want = water([sizes[s] for s in order], [5, 2, 1, 5, 2])
    assert [got[s] for s in order] == pytest.approx(want)
    assert mixing.budgets({}) == {} and mixing.budgets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("range_rows", [50_000, 5])
def test_mix(spark, range_rows):
    for docs in (documents(spark), frame(spark, AWKWARD)):
        rows = as_dicts(mixing.mix(docs, range_rows=range_rows))
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(blank_words(r["text"]))) for r in docs.collect())
        by = defaultdict(list)
        for r in rows:
            by[r["source"]].append(r)
            assert 0 <= r["taken"] <= 3 * r["size"]
        for own in by.values():
            assert sum(r["size"] for r in own) == own[0]["source_size"]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
            # at most one document of a source is cut
            assert sum(1 for r in own if r["size"] and r["taken"] % r["size"]) <= 1
        again = as_dicts(mixing.mix(docs, range_rows=range_rows))
        key = lambda r: repr(sorted(r.items(), key=str))
        assert sorted(rows, key=key) == sorted(again, key=key)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents(spark):
    docs = frame(spark, AWKWARD)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    known = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= known
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


# exact dedup


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        v = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v)) == v).all()
    v = np.arange(100, dtype=np.uint64) + np.uint64(2**63)
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v)) == v).all()
    assert len(exact_dedup.rice_decode(exact_dedup.rice_encode(v[:0]))) == 0


def test_exact_dedup(spark, monkeypatch):
    for docs in (documents(spark), frame(spark, AWKWARD).repartition(3)):
        rows = as_dicts(exact_dedup.exact_dedup(docs, owner_rows=20))
        groups = defaultdict(list)
        for r in docs.collect():
            groups[BLANK.sub("", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
        want = Counter()
        for bare, own in groups.items():
            best = min(own, key=lambda x: (x[0], x[1], x[2] or 0))
            sha = hashlib.sha256(bare.encode()).hexdigest()
            want.update((o[2], best[2], len(own), sha) for o in own)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
        assert sum(r["kept"] for r in rows) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_dedup_hot_groups_and_shuffled_suspects(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("t"), F.col("id") % 1100)).alias("text"))
    rows = as_dicts(exact_dedup.exact_dedup(docs, owner_rows=100))
    hot = [r for r in rows if r["doc_id"] % 3 == 0]
    assert {(r["keep_id"], r["group_size"]) for r in hot} == {(0, 1000)} and sum(r["kept"] for r in hot) == 1


# toxicity


def test_toxicity_held_out(spark):
    rows = as_dicts(QUERIES["op5_kneser_ney_toxicity"](spark, "/root/testdata/sf0.1"))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert np.mean([s >= 0.5 for s in bad]) > 0.9 and np.mean([s >= 0.5 for s in good]) < 0.02
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_awkward(spark):
    docs = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (9, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    rows = as_dicts(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in as_dicts(toxicity.score(docs, empty))} == {0.5}
    assert toxicity.score(docs.limit(0), empty).count() == 0


def brute_ratio(toxic, ordinary):
    """The two models with dictionaries; P(class, before, word) and the vocabulary."""
    def lr(a, b, all_a, all_b):
        total, out = all_a + all_b, 0.0
        for seen, of in ((a, all_a), (b, all_b)):
            for o, e in ((seen, (a + b) * of / total), (of - seen, (total - a - b) * of / total)):
                out += 2 * o * log(o / e) if o else 0.0
        return out

    def discount(values):
        once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return once / (once + 2 * twice) if once else 0.5

    names = {w for t in toxic + ordinary for w in t}
    sides = []
    for texts in (toxic, ordinary):
        pairs, pair_in, word_in = Counter(), defaultdict(set), defaultdict(set)
        for t in {tuple(t) for t in texts}:
            for v, w in zip((None, *t), t):
                pairs[v, w] += 1
                pair_in[v, w].add(t[:4])
                word_in[w].add(t[:4])
        sides.append((pairs, pair_in, word_in, Counter(w for _, w in pairs), len({tuple(t[:4]) for t in texts})))
    n0, n1 = sides[0][4], sides[1][4]
    after = [s[3] for s in sides]
    total = [sum(x.values()) for x in after]
    shared = {w: (after[0][w] + after[1][w] + 0.5) / (sum(total) + 0.5 * (len(names) + 1)) for w in names}
    cut = [discount(x.values()) for x in after]
    own = [{w: max(after[k][w] - cut[k], 0) / total[k] + cut[k] * len(after[k]) / total[k] * shared[w] for w in names} for k in (0, 1)]

    def told(count0, count1, of, p0, p1):
        return lr(count0, count1, n0, n1) > 8 + 2 * log(max(2, of)) and abs(log(p0 / p1)) >= 1

    uni = [{}, {}]
    for w in names:
        if told(len(sides[0][2][w]), len(sides[1][2][w]), len(names), own[0][w], own[1][w]):
            uni[0][w], uni[1][w] = own[0][w], own[1][w]
    for size in toxicity.BEGINNINGS:
        groups = defaultdict(list)
        for w in names - set(uni[0]):
            if len(w) > size:
                groups[w[:size]].append(w)
        every = {w[:size] for w in names if len(w) > size}
        counts = [{g: sum(after[k][w] for w in groups[g]) for g in every} for k in (0, 1)]
        d = [discount([*counts[k].values()]) for k in (0, 1)]
        left = [cut[k] * len(after[k]) / total[k] for k in (0, 1)]
        mass = [{g: max(counts[k][g] - d[k], 0) / total[k] + left[k] * sum(shared[w] for w in ws) for g, ws in groups.items()} for k in (0, 1)]
        for g, ws in groups.items():
            texts = [len(set().union(*[sides[k][2][w] for w in ws])) for k in (0, 1)]
            if mass[0][g] > 0 and mass[1][g] > 0 and told(*texts, len(every), mass[0][g], mass[1][g]):
                for k in (0, 1):
                    uni[k].update({w: mass[k][g] * shared[w] / sum(shared[x] for x in ws) for w in ws})
    rest = [(1 - sum(u.values())) / (1 - sum(shared[w] for w in u)) for u in uni]
    uni = [{w: u.get(w, r * shared[w]) for w in names} for u, r in zip(uni, rest)]
    keys, bi = set(sides[0][0]) | set(sides[1][0]), [{}, {}]
    d = [discount(s[0].values()) for s in sides]

    def raw(k, v, w):
        mine = {x: c for (h, x), c in sides[k][0].items() if h == v}
        h = sum(mine.values())
        return max(mine.get(w, 0) - d[k], 0) / h + d[k] * len(mine) / h * uni[k][w] if h else uni[k][w]

    for v, w in keys:
        if lr(len(sides[0][1][v, w]), len(sides[1][1][v, w]), n0, n1) > 8 + 2 * log(max(2, len(keys))):
            p = raw(0, v, w), raw(1, v, w)
            if abs(log(p[0] / p[1])) >= 1:
                bi[0][v, w], bi[1][v, w] = p

    def prob(k, v, w):
        if (v, w) in bi[k]:
            return bi[k][v, w]
        mine = {x: p for (h, x), p in bi[k].items() if h == v}
        return (1 - sum(mine.values())) / (1 - sum(uni[k][x] for x in mine)) * uni[k][w]

    return prob, sorted(names), [r * 0.5 / (sum(total) + 0.5 * (len(names) + 1)) for r in rest]


def test_kneser_ney_equals_brute_force():
    rng = np.random.default_rng(4)
    common = [f"w{i}" for i in range(40)]

    def text(extra):
        out = [common[int(i)] for i in rng.integers(0, 40, 30)]
        for x in extra:
            out[int(rng.integers(0, 30))] = x
        return [w.encode() for w in out]

    toxic = [text(["vile", "w1", "badstem" + "abcdefgh"[int(rng.integers(8))] + str(i)]) for i in range(60)]
    toxic = [[*t[:10], b"w3", b"hiss", *t[10:]] for t in toxic] + toxic[:3]
    ordinary = [text(["nice"] if i % 2 else ["w1"]) for i in range(90)]
    number = {}
    data = [[np.array([number.setdefault(w, len(number)) for w in t], dtype=np.int32) for t in x] for x in (toxic, ordinary)]
    names = list(number)
    model = toxicity.Ratio(*data, names, toxicity.stems_of(names))
    prob, words, unseen = brute_ratio([[w.decode() for w in t] for t in toxic], [[w.decode() for w in t] for t in ordinary])
    assert {b"vile", b"hiss", b"nice"} <= model.words.keys() and "badste" in model.beginnings[0] and b"w3" in model.histories
    for v in (None, "w1", "w3", "vile"):  # distributions, with the words that were never seen
        assert all(0.999 < sum(prob(k, v, w) for w in words) + unseen[k] < 1.001 for k in (0, 1))
    for t in [*toxic[:10], *ordinary[:10], [b"w3", b"hiss", b"badstemxyz9", b"w3", b"w1"]]:
        known = [w if w in number else b"badstema0" for w in t]
        known = [w if w in number else next(x for x in names if x.startswith(b"badstem")) for w in known]
        pairs = [(None if v is None else v.decode(), w.decode()) for v, w in zip([None, *known], known)]
        want = [log(prob(0, v, w)) - log(prob(1, v, w)) for v, w in pairs]
        assert model.differences(t) == pytest.approx(want, abs=1e-9)
        assert model.evidence(t) == pytest.approx(sum(want) / len(want), abs=1e-9)
    long = toxic[0] * 9
    d = model.differences(long)
    assert model.evidence(long) == pytest.approx(max(sum(d[i : i + 50]) / 50 for i in range(len(d) - 49)))
    assert model.evidence([]) == 0.0


def test_toxicity_bounds_its_sample(spark):
    rows = [(i, ("word%d " % (i % 7)) * 9000, i % 2) for i in range(40)] + [(100 + i, "short one", 1) for i in range(3)]
    table = spark.createDataFrame(rows, "id long, text string, y int")
    out, share = common.sampled_pieces(table, "y", 60_000)
    sizes = {r["y"]: r["b"] for r in out.groupBy("y").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    assert all(20_000 < b < 60_000 * 1.2 for b in sizes.values()) and all(0 < s < 1 for s in share.values())
    out, share = common.sampled_pieces(table, "y", 10**9)
    assert share == {0: 1.0, 1: 1.0} and out.agg(F.sum(F.octet_length("text"))).first()[0] == sum(len(t) for _, t, _ in rows)


# simhash


def brute_fingerprint(text):
    words = blank_words(lower(text))
    parts = [" ".join(p) for p in zip(words, words[1:])] or words[:1]
    if not parts:
        return 0
    hs = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_links(ids, fps, most=6):
    adj = {i: [j for j in range(len(fps)) if j != i and bin(fps[i] ^ fps[j]).count("1") <= most] for i in range(len(fps))}
    root = {}
    for i in range(len(fps)):
        if i in root:
            continue
        todo, comp = [i], {i}
        while todo:
            for j in adj[todo.pop()]:
                if j not in comp:
                    comp.add(j)
                    todo.append(j)
        named = [ids[j] for j in comp if ids[j] is not None]
        for j in comp:
            root[j] = min(named) if named else None
    return Counter((ids[i], f"{fps[i]:016x}", len(adj[i]), root[i]) for i in range(len(fps)))


def test_simhash(spark):
    for docs in (documents(spark), frame(spark, AWKWARD)):
        rows = docs.select("doc_id", "text").collect()
        want = brute_links([r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows])
        got = Counter((r["doc_id"], r["fingerprint"], r["n_near"], r["component_id"]) for r in as_dicts(simhash.near_duplicates(docs)))
        assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_lose_none(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**64, 30, dtype=np.uint64)]
    fps = set(base)
    for b in base:
        for d in (1, 3, 5, 6, 6, 6, 7, 8):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, d, replace=False)))
    # differing bits spread over the segments as evenly as can be
    fps |= {base[0] ^ 0x0003000300030000, base[0] ^ 0x0001000300030001, base[1] ^ 0x8001800000010001}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = Counter(tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.links(nodes).collect())
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 6}
    assert set(got) == want and set(got.values()) == {1}


def test_components_of_a_path(spark):
    n = 40
    edges = spark.range(n - 1).select(((F.col("id") * 37) % n).alias("a"), (((F.col("id") + 1) * 37) % n).alias("b"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == dict.fromkeys(range(n), 0)


def test_simhash_keeps_one(spark, monkeypatch):
    docs = frame(spark, AWKWARD)
    near = as_dicts(simhash.near_duplicates(docs))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and out.count() == len({r["component_id"] for r in near})
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert simhash.keep_one(docs).count() == out.count()
    assert simhash.keep_one(docs.limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    texts = [t for _, t, _, _ in AWKWARD if t] + [r["text"] for r in documents(spark).limit(60).collect()]
    texts += ["a<|endoftext|>b", " <|endoftext|> x", "<|endoftext|><|endoftext|>", "it's  we'll   \n\n x", " a   b", "\x1c\x85 z"]
    texts += ["a" + chr(c) + chr(c) + " " + chr(c) + "b1" for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    model = tokens.load(vocabulary)
    assert [tokens.count_tokens(t, model) for t in texts] == want
    assert [tokens.count_tokens(t, model, chunk=200, overlap=40) for t in texts] == want


def test_tokens_resynchronise(vocabulary):
    model = tokens.load(vocabulary)
    rng = np.random.default_rng(3)
    for text in ("lorem ipsum dolor " * 400, "nospace" * 500, "x" * 3000, " " * 3000, "ab  cd\n\n" * 400, "<|endoftext|> a" * 200, "".join(rng.choice(list("ab \n1.é"), 4000))):
        for chunk, overlap in ((300, 40), (150, 64), (1000, 10)):
            assert tokens.count_tokens(text, model, chunk=chunk, overlap=overlap) == len(model.encode(text))


def test_token_rows(spark, vocabulary):
    rows = as_dicts(tokens.token_counts(frame(spark, AWKWARD), vocabulary))
    assert len(rows) == len(AWKWARD)
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["n_bytes"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[7]["over_limit"] and not got[1]["over_limit"]
    assert tokens.token_counts(documents(spark).limit(0), vocabulary).count() == 0


# decontamination


def brute_hits(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        if not w:
            continue
        n = min(width, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found |= {str(item)} - {"None"}
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("set_bytes", [decontaminate.SET_BYTES, 0])
def test_decontamination(spark, monkeypatch, set_bytes):
    monkeypatch.setattr(decontaminate, "SET_BYTES", set_bytes)
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (10, "short one"), (2, "Hello, GENERAL"), (3, None), (4, ""), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (10, "again 'quoted\" \\ words"), (6, "word word word word word word word word word word word"), (None, "an item without any id of its own but with twelve words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(20, "x " + long.upper() + " y short; one", "en", "a"), (21, "w3 w4 w5 w6 w7 w8 w9 w10 w11", "en", "a"), (23, "see: an item without any id of its own but with twelve.", "en", "a"), (24, "an item without any id of its own but", "en", "a"), (22, "Again quoted words w3-w4-w5-w6-w7-w8-w9-w10-w11-w12", "en", "a")]
    docs = frame(spark, AWKWARD + more)
    rows = as_dicts(decontaminate.contamination(docs, bench, prefix="__"))
    assert Counter((r["doc_id"], r["__n_words"], tuple(sorted(r["__hits"])), tuple(r["__items"])) for r in rows) == Counter((i, *map(lambda x: tuple(x) if isinstance(x, list) else x, brute_hits(t, items))) for i, t, _, _ in AWKWARD + more)
    kept = as_dicts(decontaminate.remove_contaminated(docs, bench))
    assert {r["doc_id"] for r in kept} == {i for i, t, _, _ in AWKWARD + more if not brute_hits(t, items)[1]}
    spans = {r["doc_id"]: r["text"] for r in as_dicts(decontaminate.remove_contaminated(docs, bench, spans=True))}
    assert spans[20].split() == ["x", "y", ";"] and spans[21] == more[1][1]
    assert not brute_hits(spans[22], items)[1] and spans[3] is None
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# PII


def brute_base(text):
    text, out = text or "", []
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = digits(s)[::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    forms = [
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(s)),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    for k, form, valid in forms:
        out += [(m.start(), k, m.end()) for m in re.finditer(form, text) if valid(m.group())]
    return sorted(out)


PII_TEXTS = [
    "mail a.b@c.de_f@g.hi x@y @z.z a@b a@b.c. end.of@line.com",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004 4111  1111 1111 1111",
    "+1 (988) 555-2485 +49 30 1234567 +12 +123 ++1 234 567 890 1 +1234567890123456",
    "é😀 x@ö.de ü@a.bc 😀1.1.1.1😀 token=9f8a7b6c",
    "1" * 5000 + " " + "a" * 5000 + "@" + "b." * 3000 + "c",
    "1 " * 4000,
]


def test_pii_base(spark):
    docs = frame(spark, AWKWARD + [(100 + i, t, "en", "a") for i, t in enumerate(PII_TEXTS)])
    rows = as_dicts(pii.find_pii(docs))
    texts = Counter((i, tuple(brute_base(t))) for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter((r["doc_id"], tuple((s["start"], s["k"], s["end"]) for s in r["base"])) for r in rows) == texts
    assert pii.find_pii(docs.limit(0)).count() == 0
    names = ("email", "ip", "card", "phone")
    for r, d in zip(rows, as_dicts(pii.digest(pii.find_pii(docs)))):
        line = ",".join(f"{names[s['k']]}:{s['start']}:{s['end']}" for s in r["base"])
        assert d["doc_id"] != r["doc_id"] or d["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() or r["doc_id"] == 1


def test_pii_whole_table(spark, docs_rows):
    got = {r["doc_id"]: [(s["start"], s["k"], s["end"]) for s in r["base"]] for r in as_dicts(pii.find_pii(documents(spark)))}
    assert got == {i: brute_base(t) for i, t, _, _ in docs_rows}


def test_pii_bootstraps(spark):
    """Patterns around seeds find addresses that have no such form; a second round spreads on."""
    rows = [(i, f"please write to user{i}@mail{i}.org today friend", "en", "a") for i in range(12)]
    rows += [(50, "please write to user77[at]mail77 today friend", "en", "a"), (51, "section 7 of chapter 12 today", "en", "a")]
    rows += [(52, "elsewhere user77[at]mail77 again", "en", "a"), (53, "write to nobody today", "en", "a")]
    got = {r["doc_id"]: [(s["start"], s["k"], s["end"]) for s in r["spans"]] for r in as_dicts(pii.find_pii(frame(spark, rows)))}
    assert got[50] == [(16, 0, 32)] and got[52] == [(10, 0, 26)] and got[51] == [] and got[53] == []
    assert all(got[i] == brute_base(rows[i][1]) for i in range(12))


def brute_slots(text, patterns):
    """(place, string, pattern) of the words without digit or at sign in the slots of patterns."""
    text, ends = text or "", [0]
    for start, _, end in brute_base(text):
        if start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            ends += [start, end]
    masked = "\ue000".join(text[a:b] for a, b in zip(ends[::2], [*ends[1::2], len(text)]))
    words = BLANK.split(re.sub("[1-9]", "0", re.sub("[\n\r]", " \ue001 ", "\n" + masked).lower()))
    c = ["\ue000" if "\ue000" in w else w for w in words]
    sign = lambda x: unicodedata.category(x)[0] not in "LN"
    out = []
    for i in range(2, len(c)):
        own = "".join(dropwhile(sign, "".join(dropwhile(lambda x: sign(x) and x != "+", c[i]))[::-1]))[::-1]
        after = c[i + 1] if i + 1 < len(c) else ""
        around = [f"l {c[i - 2]} {c[i - 1]}"] * bool(c[i - 2]) + [f"s {c[i - 1]} _ {after}"] * bool(after)
        out += [(i, own, p) for p in around if own and not re.search("[0@\ue000\ue001]", c[i]) and p in patterns]
    return out


def test_pii_slots(spark):
    """What is in the slots, and that other words aren't looked at further though a pattern begins
    with an entity: of 60,000 words, only those in slots come to be compared with the patterns."""
    m, b = "\ue000", "\ue001"
    texts = [*PII_TEXTS, "write to (some.one), or x@y.zz and Him! or\n\nwrite to\tyou 5 or", "to a@b.cc friend today a@b.cc\nfriend today", f"raw x{m}y friend today {b} z", "-- to + or to -+a- or", "word " * 60_000]
    docs = frame(spark, AWKWARD + [(100 + i, t, "en", "a") for i, t in enumerate(texts)])
    patterns = {"l write to", "s to _ or", f"l to {m}", f"s {m} _ today", f"l {b} {b}", f"l {m} friend", f"s {b} _ to", "l world of", "l or to"}
    df = pii._slots(docs, spark.createDataFrame([(p,) for p in sorted(patterns)], "pattern string"), "doc_id", "text")
    got = Counter((r["id"], r["i"], r["string"], r["pattern"]) for r in df.collect())
    want = Counter((i, *x) for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()] for x in brute_slots(t, patterns))
    assert got == want and len({x[3] for x in want}) > 6

    def compared(plan):
        """Rows of the upper explode, that of patterns."""
        if plan.nodeName() == "Generate":
            return plan.metrics().apply("numOutputRows").value()
        if plan.nodeName() == "AdaptiveSparkPlan":
            return compared(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return compared(plan.plan())
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
        return next((n for n in map(compared, inner) if n is not None), None)

    assert sum(want.values()) <= compared(df._jdf.queryExecution().executedPlan()) <= 3 * sum(want.values())


# LM scoring


def brute_lm(rows, kappa=lm_scoring.KAPPA):
    """The interpolated trigram model, word by word, without an automaton."""
    toks = [(i, blank_words(lower(t)) + ["\n"], zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False) for i, t in rows]
    uni, bi, tri = Counter(), Counter(), Counter()
    train = 0
    for _, w, held in toks:
        if not held:
            uni.update(w)
            bi.update(zip([None, *w], w))
            tri.update(zip([None, *w], w, w[1:]))
            train += 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, w, held in toks:
        base = [(uni[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        score = 0.0
        for k, (x, p) in enumerate(zip(w, base)):
            h = w[k - 1] if k else None
            c = uni[h] if k else train
            if c:
                p = (bi[h, x] + kappa[0] * p) / (c + kappa[0])
            if k:
                g = w[k - 2] if k > 1 else None
                if bi[g, h]:
                    p = (tri[g, h, x] + kappa[1] * p) / (bi[g, h] + kappa[1])
            score += log10(p)
        out.append((i, held, len(w), sum(uni[x] > 0 for x in w), n, sum(map(log10, base)), score))
    return out


def test_lm_scores(spark):
    for docs, size in ((documents(spark), 40_000), (frame(spark, AWKWARD), 100), (documents(spark), 12_000_000)):
        got = sorted(as_dicts(lm_scoring.score_texts(docs, common.fold(F.col("doc_id"), 5, 1), block_bytes=size, owner_tokens=5000)), key=str)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        want = sorted((dict(zip(names, r)) for r in brute_lm([(r["doc_id"], r["text"]) for r in docs.collect()])), key=str)
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=lambda r: (r["doc_id"] or -1, r["n_tokens"])), sorted(want, key=lambda r: (r["doc_id"] or -1, r["n_tokens"]))):
            assert {k: a[k] for k in names[:5]} == {k: b[k] for k in names[:5]}
            assert a["base_score"] == pytest.approx(b["base_score"]) and a["score"] == pytest.approx(b["score"])
    empty = lm_scoring.score_texts(docs.limit(0), common.fold(F.col("doc_id"), 5, 1))
    assert empty.count() == 0


def test_lm_codes():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
    for k in (keys, keys[:1], keys >> np.uint64(30), np.arange(300, dtype=np.uint64), np.array([0, 1, 2, 2**63], dtype=np.uint64), keys[:0]):
        k = np.unique(k)
        assert (lm_scoring.unpack_keys(lm_scoring.pack_keys(k)) == k).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(counts), 6) == counts).all()


def test_scratch_needs_a_shared_folder(spark):
    assert common.root(spark)


def test_lone_rows(spark):
    docs = frame(spark, AWKWARD[:1])
    assert sharding.shard_hilbert(docs).count() == 1 and simhash.near_duplicates(docs).count() == 1
    assert exact_dedup.exact_dedup(docs).count() == 1 and mixing.mix(docs).count() == 1


def test_one_query_each():
    assert [int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")] == list(range(1, 11))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_are_never_altered(spark, kind):
    """Ids beyond 2 ** 53 beside a null one."""
    ids = [None, *[2**60 + k for k in range(6)]]
    docs = spark.createDataFrame([(i, f"text {k % 3} of three") for k, i in enumerate(ids)], "doc_id long, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text").coalesce(1)
    want = Counter(None if i is None else (i if kind == "long" else str(i)) for i in ids)
    dedup = as_dicts(exact_dedup.exact_dedup(docs))
    assert Counter(r["doc_id"] for r in dedup) == want
    assert {r["keep_id"] for r in dedup} == set(list(want)[1:4]) and all(r["group_size"] in (2, 3) for r in dedup)
    assert Counter(r["doc_id"] for r in as_dicts(lm_scoring.score_texts(docs, F.lit(False)))) == want


def test_dedup_splits_clashing_digests(spark):
    rows = [(1, "one"), (2, "o n e"), (3, "two"), (4, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in as_dicts(exact_dedup.exact_dedup(docs, digest=lambda text: b"\1" * 32))}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (5, 2), 5: (5, 2)}
