"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts. A pair's discounted counts back off to a word's
continuation counts (the number of different words before it), these to those of all words with its
beginning (6, 5 or 4 letters, so that endings don't hide a stem), and these to the continuation counts
of both classes together. ``log P(text | toxic) - log P(text | ordinary)`` is added up over all
tokens of a passage and divided by their number; a text's evidence is that of its most toxic passage
of ``PASSAGE`` words, so that a few words in a long text count as they do in a short one. A logistic
function, fitted on rows that the models haven't seen, turns it into a score.

Rare expressions are smoothed by tying: an expression has class-conditional probabilities of its own
only where the numbers of documents with it differ between the classes beyond chance (a
likelihood-ratio test, stricter the more expressions there are) and the probabilities by a factor e.
For all others both models use the counts that they share (words) or back off (pairs), and what the
others leave is renormalised, so both remain distributions. Without tying, the accidents of a sample
outweigh its few toxic words: on the 10,000-document table plain interpolation finds 9 % of held-out
toxic documents at 1 % of others.

Fitting uses a bounded sample of the labelled rows (``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` of text a
class, in pieces of the texts, chosen by hashes). Scoring reads every whole text in one pass, without
a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checked_join, sampled_pieces, share_threshold, written

#: Bytes of text that a class's model is fitted on at most.
TRAIN_BYTES = 8_000_000
#: Rows whose pieces these are drawn from, about.
TRAIN_ROWS = 20_000
#: Words of a passage.
PASSAGE = 50
#: First words by which changed copies are known.
FIRST = 4
#: Letters of the beginnings of words, longest first.
BEGINNINGS = (6, 5, 4)
#: Words whose differences a worker remembers.
REMEMBERED = 500_000
#: Least difference of log-probabilities for an expression to be judged by itself.
LEAST_RATIO = 1.0
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of letters and digits, in lower case."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _differ(a: np.ndarray, b: np.ndarray, all_a: int, all_b: int) -> np.ndarray:
    """Whether the shares a of all_a and b of all_b differ beyond chance, among so many."""
    both, where = np.unique(a * (all_b + 1) + b, return_inverse=True)
    a_, b_, total = both // (all_b + 1), both % (all_b + 1), max(1, all_a + all_b)
    out = np.zeros(len(both))
    for seen, of in ((a_, all_a), (b_, all_b)):
        for o, e in ((seen, (a_ + b_) * of / total), (of - seen, (total - a_ - b_) * of / total)):
            out += 2 * np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return (out > 8 + 2 * np.log(max(2, len(a))))[where]


def _discount(counts: np.ndarray) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def _beginning(word: bytes, size: int) -> str | None:
    """The first letters of a word; None for a word that isn't longer."""
    letters = word.decode("utf-8", "replace")
    return letters[:size] if len(letters) > size else None


def stems_of(names: list[bytes]) -> list[tuple[list[str], np.ndarray]]:
    """For each size of ``BEGINNINGS`` the beginnings, and which of them each word has, or -1."""
    out = []
    for size in BEGINNINGS:
        found: dict[str, int] = {}
        group = np.array([-1 if (x := _beginning(w, size)) is None else found.setdefault(x, len(found)) for w in names], dtype=np.int64)
        out.append((list(found), group))
    return out


class Counts:
    """What a class's model is made of. Words are numbers below ``n``; ``n`` is the start of a text.
    Of equal texts one counts; where it matters how many texts have an expression, those with the
    same first ``FIRST`` words count as one, for most of them are copies with changes."""

    def __init__(self, texts: list[np.ndarray], n: int):
        texts = list({t.tobytes(): t for t in texts}.values())
        heads: dict[bytes, int] = {}
        head = np.array([heads.setdefault(t[:FIRST].tobytes(), len(heads)) for t in texts], dtype=np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        w = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[np.cumsum(lengths) - lengths] = n
        doc = np.repeat(head, lengths)
        self.texts = len(heads)
        #: pairs as v * (n + 1) + w, their counts, and in how many texts they are
        self.pairs, place, self.pair_n = np.unique(v * (n + 1) + w, return_inverse=True, return_counts=True)
        self.pair_texts = np.bincount(np.unique(doc * max(1, len(self.pairs)) + place) % max(1, len(self.pairs)), minlength=len(self.pairs))
        self.after = np.bincount(self.pairs % (n + 1), minlength=n)[:n]  # different words before a word
        self.fan = np.bincount(self.pairs // (n + 1), minlength=n + 1)  # different words after a word
        self.history = np.bincount(v, minlength=n + 1)
        #: words of texts, as text * n + word
        self.text_words = np.unique(doc * n + w)
        self.word_texts = np.bincount(self.text_words % max(1, n), minlength=n)
        self.total = max(1, int(self.after.sum()))
        self.discount, self.pair_discount = _discount(self.after), _discount(self.pair_n)
        self.left = self.discount * (self.after > 0).sum() / self.total if len(w) else 1.0


class Ratio:
    """Differences of the two models' log-probabilities, and the logistic function over evidence.

    ``words``: for words by themselves; ``beginnings``: for others with these; ``rest``: for all
    others, seen or not; ``histories``: what is added after a
    history that has pairs of its own, and these pairs' differences by their words."""

    def __init__(self, toxic: list[np.ndarray], ordinary: list[np.ndarray], names: list[bytes], stems: list[tuple[list[str], np.ndarray]]):
        n = len(names)
        c = Counts(toxic, n), Counts(ordinary, n)
        shared = (c[0].after + c[1].after + 0.5) / (c[0].after.sum() + c[1].after.sum() + 0.5 * (n + 1))
        own = [np.maximum(x.after - x.discount, 0) / x.total + x.left * shared for x in c]
        apart = _differ(c[0].word_texts, c[1].word_texts, c[0].texts, c[1].texts)
        apart &= np.abs(np.log(own[0] / own[1])) >= LEAST_RATIO
        word = [np.where(apart, p, 0.0) for p in own]
        self.words = {names[i]: float(np.log(own[0][i] / own[1][i])) for i in np.flatnonzero(apart)}
        # words that aren't told apart share the mass of their beginnings, or of all the rest
        free, self.beginnings = ~apart, []
        for found, group in stems:
            group = np.where(free, group, -1)
            of, m = np.flatnonzero(group >= 0), len(found)
            mass, texts = [], []
            for x in c:
                after = np.bincount(group[of], x.after[of], m)
                mass.append(np.maximum(after - _discount(after), 0) / x.total + x.left * np.bincount(group[of], shared[of], m))
                there = group[x.text_words % max(1, n)]
                pairs = np.unique((x.text_words // max(1, n))[there >= 0] * max(1, m) + there[there >= 0])
                texts.append(np.bincount(pairs % max(1, m), minlength=m))
            used = (mass[0] > 0) & (mass[1] > 0)
            ratio = np.where(used, np.log(np.where(used, mass[0], 1) / np.where(used, mass[1], 1)), 0.0)
            told = _differ(texts[0], texts[1], c[0].texts, c[1].texts) & (np.abs(ratio) >= LEAST_RATIO)
            self.beginnings.append({found[i]: float(ratio[i]) for i in np.flatnonzero(told)})
            mine = of[told[group[of]]]
            among = np.bincount(group[mine], shared[mine], m)
            for k in (0, 1):
                word[k][mine] = mass[k][group[mine]] * shared[mine] / among[group[mine]]
            free[mine] = False
        rest = [(1 - p.sum()) / (1 - shared[~free].sum()) for p in word]
        word = [np.where(free, r * shared, p) for p, r in zip(word, rest)]
        self.rest = float(np.log(rest[0] / rest[1]))
        self._memory: dict[bytes, float] = {}

        keys = np.union1d(c[0].pairs, c[1].pairs)
        texts, count = np.zeros((2, len(keys)), np.int64), np.zeros((2, len(keys)), np.int64)
        for k, x in enumerate(c):
            at = np.searchsorted(keys, x.pairs)
            texts[k, at], count[k, at] = x.pair_texts, x.pair_n
        some = _differ(texts[0], texts[1], c[0].texts, c[1].texts)
        keys, count = keys[some], count[:, some]
        v, w = keys // (n + 1), keys % (n + 1)
        pair = []
        for k, x in enumerate(c):
            h = x.history[v]
            kept = np.maximum(count[k] - x.pair_discount, 0) / np.maximum(h, 1)
            left = np.where(h > 0, x.pair_discount * x.fan[v] / np.maximum(h, 1), 1.0)
            pair.append(kept + left * word[k][w])
        apart = np.abs(np.log(pair[0] / pair[1])) >= LEAST_RATIO if len(keys) else np.zeros(0, bool)
        v, w = v[apart], w[apart]
        sums = [(np.bincount(v, pair[k][apart], n + 1), np.bincount(v, word[k][w], n + 1)) for k in (0, 1)]
        left = [(1 - p) / (1 - u) for p, u in sums]
        self.histories: dict[bytes | None, tuple[float, dict[bytes, float]]] = {}
        for i, j, x in zip(v.tolist(), w.tolist(), np.log(pair[0][apart] / pair[1][apart]).tolist()):
            name = names[i] if i < n else None
            self.histories.setdefault(name, (float(np.log(left[0][i] / left[1][i])), {}))[1][names[j]] = x
        self.slope, self.shift = 1.0, 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": {}}

    def word(self, word: bytes) -> float:
        """Difference for a word in a history without pairs of its own."""
        found = self.words.get(word)
        for size, told in zip(BEGINNINGS, self.beginnings):
            if found is not None:
                break
            found = told.get(_beginning(word, size)) if told else None
        if len(self._memory) >= REMEMBERED:
            self._memory.clear()
        found = self._memory[word] = self.rest if found is None else found
        return found

    def differences(self, words: list[bytes]) -> list[float]:
        """For each token, the log-probability under the toxic model less that under the other."""
        get = self._memory.get
        out = [x if (x := get(w)) is not None else self.word(w) for w in words]
        if self.histories and words:
            known = self.histories
            for i, v in enumerate([None, *words[:-1]]):
                if v in known:
                    more, after = known[v]
                    out[i] = after[words[i]] if words[i] in after else out[i] + more
        return out

    def evidence(self, words: list[bytes]) -> float:
        """Length-normalised difference of the most toxic passage; 0 for no words."""
        if not words:
            return 0.0
        values = self.differences(words)
        if len(words) <= PASSAGE:
            return sum(values) / len(words)
        total = np.concatenate(([0.0], np.cumsum(values)))
        return float((total[PASSAGE:] - total[:-PASSAGE]).max()) / PASSAGE

    def calibrate(self, evidence: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Fit the logistic function by damped Newton steps, slightly regularised. A row of a class
        that was sampled weighs as many rows as it stands for."""
        weight = weight * (len(weight) / weight.sum())
        scale = float(np.std(evidence)) or 1.0
        x = np.stack((evidence / scale, np.ones(len(evidence))), axis=1)
        b = np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
            g = x.T @ (weight * (label - p)) - 1e-2 * b
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), g)
            b += step / max(1.0, float(np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(b[0] / scale), float(b[1])

    def score(self, text: str | None) -> float:
        z = self.slope * self.evidence(words_of(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_bytes: int = TRAIN_BYTES, train_rows: int = TRAIN_ROWS) -> Ratio:
    """Models of the labelled documents. Labels that are null are passed over; of several for an id
    the largest holds. Labels without a document, and documents without text, teach nothing; of a
    long text some pieces may be read. Without labels of both classes the score is the share of
    toxic ones, and without any 0.5."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen, share = F.lit(False), {}
    for label, count in n.items():
        share[label] = min(1.0, train_rows / count)
        chosen = chosen | ((F.col("y") == label) & (F.xxhash64("id") <= share_threshold(share[label])))
    ids = written(y.where(chosen), "toxicity-ids")  # TRAIN_ROWS a class, about
    texts = checked_join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids, "id", "inner")
    rows, part = sampled_pieces(written(texts, "toxicity-texts"), "y", train_bytes)

    number: dict[bytes, int] = {}
    data = []
    for r in sorted(rows.collect(), key=lambda r: (r["h"], r["y"])):
        words = words_of(r["text"])
        if words:
            # folds by the first words, so that copies hardly meet across them
            data.append((r["y"], xxhash.xxh3_64_intdigest(b" ".join(words[:FIRST])) % 4, np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32)))
    names = list(number)
    stems = stems_of(names)

    def model(rows: list) -> Ratio:
        return Ratio([t for label, _, t in rows if label], [t for label, _, t in rows if not label], names, stems)

    values, truth = [], []
    for k in range(4):
        made = model([x for x in data if x[1] != k])
        for label, f, t in data:
            if f == k:
                values.append(made.evidence([names[i] for i in t.tolist()]))
                truth.append(label)
    final = model(data)
    if values:
        # the classes are sampled at different shares; the score goes by their numbers in the labels
        final.calibrate(np.array(values), np.array(truth, dtype=float), np.array([1 / (share[x] * part[x]) for x in truth]))
    return final


def score(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """id, the columns of ``keep``, and the score of every row, 0 to 1.

    Null and wordless texts get the score of no evidence; long texts are read whole; repeated rows
    are scored alike; without labels every score is 0.5; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            found = pa.array([ratio.score(t) for t in batch.column("__text").to_pylist()], pa.float64())
            names = [x for x in batch.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], found], names=[*names, name])

    kinds = dict(docs.dtypes)
    columns = list(dict.fromkeys([id_col, *keep]))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"`{name}` double"])
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Ratio, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``limit``; only texts pass through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.score(t))

    return docs.where(value(F.col(f"`{text_col}`")) < limit)
