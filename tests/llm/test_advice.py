"""Cases of the review of round 1: each does less than the whole job in the code before it."""

from lexloom.llm import pii, simhash, toxicity


def spans(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["start"], s["k"], s["end"]) for s in r["spans"]] for r in pii.find_pii(docs, **options).collect()}


def test_pii_parts_of_entities_are_not_known(spark):
    texts = [f"please call me +1 (0{17 + i}) 555-77{10 + i} today friend" for i in range(12)]
    texts += ["room 017 of 555-7713 and +1 more", "see 018 there"]
    got = spans(spark, texts)
    assert got[12] == [] and got[13] == []
    assert all(got[i] == [(15, 3, 32)] for i in range(12))


def test_pii_finds_identifiers_of_several_tokens_whole(spark):
    texts = [f"please call me +1 (0{17 + i}) 555-77{10 + i} today friend" for i in range(12)]
    texts += ["please call me 017 555 9999 today friend", "elsewhere 017 555 9999 again", "beside 12 017 555 9999 5 again", "and 017 or 9999 alone"]
    got = spans(spark, texts)
    assert got[12] == [(15, 3, 27)] and got[13] == [(10, 3, 22)] and got[14] == [(10, 3, 22)] and got[15] == []


def test_one_of_each_component_stays_whatever_its_ids(spark):
    def text(i):
        return " ".join(f"word{(i * 7919 + k * k * 31) % 9973}" for k in range(60))

    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4) + " "), (8, text(5)), (9, text(5))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"].strip()) for r in kept) == sorted([("None", text(1)), ("None", text(2)), ("7", text(3)), ("7", text(4)), ("8", text(5))])


def test_score_does_not_depend_on_the_sample_of_a_class(spark):
    """A word in all of few toxic and a tenth of many ordinary documents tells less than a half."""
    def text(i, marked):
        words = [f"word{(i * 7919 + k * k * 31) % 997}" for k in range(60)]
        return " ".join(w + " vilestword" if marked and k % 6 == 0 else w for k, w in enumerate(words))

    rows = [(i, text(i, i < 100 or i % 10 == 0), int(i < 100)) for i in range(2100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    marked, size = text(5000, True), sum(len(t) for _, t, _ in rows) // len(rows)
    whole = toxicity.fit(docs, labels).score(marked)
    sampled = toxicity.fit(docs, labels, train_bytes=80 * size).score(marked)
    assert 0.2 < whole < 0.5 and sampled < 0.5
