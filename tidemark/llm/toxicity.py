"""Toxicity by a support vector machine on a gapped subsequence kernel, with Nyström landmarks.

The kernel of two words sums, over all subsequences of four characters that both hold with few characters
skipped, decay ** (characters skipped in the one + in the other), over the kernel's norm for words of their
lengths; a word's ends count as characters. Inserted characters widen subsequences instead of breaking them.
Before that, marks, and single digits between letters, are taken out and runs of single letters are joined, so that ``i.d.i.o.t`` and ``i d i o t``
are words again. The kernel of two sentences is the sum over their words, over the root of their number.

The SVM is trained on sentences of labelled texts, each with the label of its text, as Nyström features against
landmark strings: the runs of four characters, word ends among them, that tell most of toxic texts, and words of
clean texts. As the
kernel is an inner product of explicit weights of subsequences, in 2 ** 21 classes by hash, the landmarks fold
into one table, and scoring a text is a few look-ups per character. A word's evidence is the logarithm of how much
more often toxic texts have words of its margin, never less for a larger margin; a text's score is a logistic of the
sum over its eight largest margins and of its length and its largest evidence, both fitted on labelled texts. So one word may tell where clean
texts never have it, and only its repetition where they do.

Training reads at most ``sample`` labelled texts; the SVM is fitted on at most ``sentences`` of each label, then
once more with as many of the clean ones nearest to toxic ones and the most toxic ones with inserted characters
(documented bounds). Scoring reads every whole text.

A null or empty text has no word: it gets the logistic at the margin floor. Nulls in doc_id: such rows
are scored and never held out. A label whose toxic is null is not learned from. Without any toxic or
any clean label the score is the share of toxic labels (0 without labels). Repeated rows get equal
scores; extra columns are not read. Rows that repeat a labelled doc_id count as one in the training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, table

CLASSES = 64
END, PUNCTUATION, DIGIT, LATIN, OTHER = 0, 27, 28, 30, 63
#: Places of the four characters of a subsequence, from its first.
PATTERNS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4), (0, 1, 3, 5), (0, 2, 3, 5), (0, 2, 4, 5), (0, 2, 4, 6))
TABLE_BITS = 21
SLICE = 250_000
FLOOR = -3.0
TOP = 8
LEVELS = np.arange(FLOOR, 6.01, 0.25)  # of margins, for the evidence


def character_classes() -> np.ndarray:
    """Class of each code point below 0x250: lower-cased letters, digits, punctuation, ends of words."""
    out = np.full(0x250, OTHER, np.uint8)
    for c in range(0x250):
        low = chr(c).lower()
        if chr(c).isspace():
            out[c] = END
        elif "a" <= low <= "z" and len(low) == 1:
            out[c] = 1 + ord(low) - ord("a")
        elif chr(c).isdigit():
            out[c] = DIGIT
        elif len(low) == 1 and 0xDF <= ord(low) <= 0xFF and low.isalpha():
            out[c] = LATIN + ord(low) - 0xDF
        elif not chr(c).isalpha():
            out[c] = PUNCTUATION
    return out


_CLASS = character_classes()


@dataclass(frozen=True)
class Kernel:
    decay: float = 0.8

    def weight(self, places: tuple[int, ...]) -> float:
        return self.decay ** (places[3] - 3)

    def norms(self, longest: int) -> np.ndarray:
        """Square root of the kernel of a word with itself when no subsequence repeats, by length."""
        lengths = np.arange(longest + 1)
        total = sum(self.weight(p) ** 2 * np.maximum(0, lengths + 2 - p[3]) for p in PATTERNS)
        return np.sqrt(np.maximum(total, 1.0))


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], OTHER).astype(np.uint8)


def class_by_hash(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)


def subsequences(classes: np.ndarray, kernel: Kernel) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """By pattern: class of the subsequence at each second character, whether it is inside one word, and weight."""
    pad = np.zeros(8, np.uint8)
    padded = np.concatenate([pad, classes, pad]).astype(np.uint32)
    n = len(classes)
    at = lambda shift: padded[7 + shift : 7 + shift + n]
    inside = [at(s) != END for s in range(1, 6)]
    for p in PATTERNS:
        valid = inside[0]
        for s in range(1, p[3] - 1):
            valid = valid & inside[s]
        code = ((at(0) * CLASSES + at(p[1])) * CLASSES + at(p[2])) * CLASSES + at(p[3])
        yield class_by_hash(code), valid, kernel.weight(p)


def word_bounds(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], classes != END, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts without marks, and where words start and end, and the text of each word.

    A digit between two letters counts as a mark; three or more single letters in a row are one word.
    """
    classes = classes_of("\n".join(texts) + "\n")
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letter = (classes != END) & (classes != PUNCTUATION) & (classes != DIGIT)
    keep = classes != PUNCTUATION
    keep[1:-1] &= ~((classes[1:-1] == DIGIT) & letter[:-2] & letter[2:])
    classes, of = classes[keep], of[keep]
    first, last = word_bounds(classes)
    if len(first) > 2:
        single = (last - first == 1) & (classes[first] != DIGIT)
        beside = single[1:] & single[:-1] & (of[first[1:]] == of[first[:-1]])
        no = np.zeros(1, bool)
        beside &= np.concatenate([no, beside[:-1]]) | np.concatenate([beside[1:], no])
        if beside.any():
            step = np.zeros(len(classes) + 1, np.int8)
            step[last[:-1][beside]] += 1
            step[first[1:][beside]] -= 1
            keep = np.cumsum(step[:-1]) == 0
            classes, of = classes[keep], of[keep]
            first, last = word_bounds(classes)
    return classes, first, last, of[first]


def word_features(word: str, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence classes and values of one word, of norm about 1; a word that marks and spaces fill is joined."""
    classes, first, last, _ = words_of([word])
    codes, values = [np.zeros(0, np.uint32)], [np.zeros(0)]
    for code, valid, weight in subsequences(classes, kernel):
        codes.append(code[valid])
        values.append(np.full(int(valid.sum()), weight))
    return np.concatenate(codes), np.concatenate(values) / kernel.norms(len(classes))[int((last - first).sum())]


@dataclass
class Model:
    """Weights per subsequence, bias, evidence at each of the levels, and the logistic from a text's evidence and length."""

    kernel: Kernel
    table: np.ndarray | None
    bias: float = 0.0
    evidence: np.ndarray | None = None
    slopes: tuple[float, ...] = (1.0, 0.0, 0.0)
    shift: float = 0.0
    constant: float = 0.0

    def margins_and_levels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The largest ``TOP`` word margins of each text, missing words counting as the floor, with its number of words;
        and how many of its words have a margin at each level."""
        out, levels = np.full((len(texts), TOP + 1), FLOOR), np.zeros((len(texts), len(LEVELS)), np.int64)
        out[:, TOP] = 0
        for a, b in self._slices(texts):
            margin, of = self.word_margins(texts[a:b])
            np.add.at(levels, (a + of, np.clip(np.searchsorted(LEVELS, margin, side="right") - 1, 0, len(LEVELS) - 1)), 1)
            order = np.lexsort((-margin, of))
            margin, of = margin[order], of[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            top = place < TOP
            out[a + of[top], place[top]] = margin[top]
            out[a:b, TOP] = np.bincount(of, minlength=b - a)
        return out, levels

    def margins(self, texts: list[str]) -> np.ndarray:
        return self.margins_and_levels(texts)[0]

    @staticmethod
    def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE):
                size += len(texts[b]) + 1
                b += 1
            yield a, b
            a = b

    def word_margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each word, and its text."""
        classes, first, last, of = words_of(texts)
        if not len(first):
            return np.zeros(0), of
        score = np.zeros(len(classes), np.float32)
        for code, valid, weight in subsequences(classes, self.kernel):
            score += np.where(valid, self.table[code], np.float32(0)) * np.float32(weight)
        total = np.add.reduceat(score, first)
        length = last - first
        return np.maximum(total / self.kernel.norms(int(length.max()))[length] + self.bias, FLOOR), of

    def weigh(self, levels: np.ndarray, toxic: np.ndarray) -> None:
        """Fit the evidence to the words of toxic and clean texts (a row of levels each)."""
        t, c = levels[toxic > 0].sum(0), levels[toxic == 0].sum(0)
        ratio = np.log((t + 0.5) / (t.sum() + 1)) - np.log((c + 0.5) / (c.sum() + 1))
        self.evidence = np.maximum.accumulate(np.where(LEVELS < 0, 0, np.maximum(ratio, 0)))

    def inputs(self, margins: np.ndarray) -> np.ndarray:
        """Evidence of each text from its largest margins, that of the largest alone, and the logarithm of its length."""
        evidence = np.interp(margins[:, :TOP], LEVELS + (LEVELS[1] - LEVELS[0]) / 2, self.evidence)
        return np.stack([evidence.sum(1), evidence[:, 0], np.log1p(margins[:, TOP])], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.inputs(self.margins(texts)) @ np.array(self.slopes) + self.shift, -30, 30)))


@dataclass(frozen=True)
class Training:
    """Bounds of the training; none of them depends on the size of the corpus."""

    sample: int = 6_000
    sentence_words: int = 8
    sentences: int = 8_000
    landmarks: int = 384
    runs: int = 256
    least_surprise: float = 5.0
    with_insertions: int = 3_000
    cost: float = 1.0
    seed: int = 5


def with_insertion(words: list[str], random: np.random.Generator) -> str:
    """The sentence with one character put into each of its longer words."""
    out = []
    for w in words:
        if len(w) > 4:
            at = int(random.integers(1, len(w)))
            w = w[:at] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(random.integers(36))] + w[at:]
        out.append(w)
    return " ".join(out)


def run_features(run: str) -> tuple[np.ndarray, np.ndarray]:
    """The one subsequence that a run of four characters is; ``_`` stands for the end of a word."""
    first, *rest = np.where(np.array([c == "_" for c in run]), END, classes_of(run)).tolist()
    code = first
    for c in rest:
        code = code * CLASSES + c
    return np.array([class_by_hash(np.array([code], np.uint32))[0]]), np.ones(1)


class Nystrom:
    """Features of sentences against landmarks, which are runs and words."""

    def __init__(self, runs: list[str], words: list[str], kernel: Kernel):
        self.kernel = kernel
        features = [run_features(r) for r in runs] + [word_features(w, kernel) for w in words]
        self.names = np.unique(np.concatenate([c for c, _ in features]))
        self.dense = np.zeros((len(self.names), len(features)), np.float32)
        for k, (codes, values) in enumerate(features):
            np.add.at(self.dense[:, k], np.searchsorted(self.names, codes), values)
        against = (self.dense.T @ self.dense).astype(np.float64)
        values, vectors = np.linalg.eigh(against)
        keep = values > 1e-4 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def sentences(self, texts: list[str], chunk: int = 32) -> np.ndarray:
        """The features of sentences, a row each; nothing but them is held for more than ``chunk`` sentences."""
        root = self.root.astype(np.float32)
        phi = np.zeros((len(texts), root.shape[1]), np.float32)
        for a in range(0, len(texts), chunk):
            classes, first, last, of = words_of(texts[a : a + chunk])
            if not len(first):
                continue
            value = 1 / (self.kernel.norms(int((last - first).max()))[last - first] * np.sqrt(np.bincount(of)[of]))
            rows, entries, values = [], [], []
            for code, valid, weight in subsequences(classes, self.kernel):
                at = np.minimum(np.searchsorted(self.names, code), len(self.names) - 1)
                place = np.flatnonzero(valid & (self.names[at] == code))
                word = np.searchsorted(first, place, side="right") - 1
                rows.append(of[word])
                entries.append(at[place])
                values.append(weight * value[word])
            rows, entries, values = np.concatenate(rows), np.concatenate(entries), np.concatenate(values).astype(np.float32)
            order = np.argsort(rows, kind="stable")
            rows, each = rows[order], self.dense[entries[order]] * values[order, None]
            if len(rows):
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                phi[a + rows[starts]] = np.add.reduceat(each, starts, axis=0) @ root
        return phi

    def table(self, beta: np.ndarray) -> np.ndarray:
        """The weights of subsequences that a linear function of the features comes to."""
        out = np.zeros(1 << TABLE_BITS, np.float32)
        out[self.names] = self.dense @ (self.root @ beta).astype(np.float32)
        return out


def fit_svm(phi: np.ndarray, y: np.ndarray, cost: float, block: int = 2048) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps on the squared hinge loss, added up over blocks of rows: no copy of ``phi`` is made."""
    beta, ridge = np.zeros(phi.shape[1] + 1), np.ones(phi.shape[1] + 1)
    ridge[-1] = 1e-3
    for _ in range(30):
        gradient, curvature = ridge * beta, np.diag(ridge)
        for a in range(0, len(phi), block):
            some, side = phi[a : a + block], y[a : a + block]
            gap = 1 - side * (some @ beta[:-1] + beta[-1])
            on = gap > 0
            some = np.hstack([some[on], np.ones((int(on.sum()), 1), phi.dtype)])
            gradient -= cost * ((side[on] * gap[on]).astype(phi.dtype) @ some)
            curvature += cost * (some.T @ some)
        step = np.linalg.solve(curvature, gradient)
        beta -= step
        if np.abs(step).max() < 1e-4:
            break
    return beta[:-1], float(beta[-1])


def fit_logistic(inputs: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift by ridge Newton steps; evidence never lowers a score, nor does brevity."""
    x = np.hstack([inputs, np.ones((len(inputs), 1))])
    for used in ([0, 1, 2, 3], [0, 2, 3], [0, 3]):
        w, part = np.zeros(4), x[:, used]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w[used] -= np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + 0.01 * np.eye(len(used)), part.T @ (p - y) + 0.01 * w[used])
        if w[0] >= 0 and w[1] >= 0 and w[2] <= 0:
            break
    return (max(float(w[0]), 1e-3), float(w[1]), float(w[2])), float(w[3])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def run_counts(known: DataFrame) -> DataFrame:
    """(run, word, t, c): the runs of four characters of each word, and in how many contexts toxic and clean texts have the word.

    A context is the two neighbouring words. Copies of one text repeat its contexts, and what only copies share is
    no evidence.
    """
    # Each expression on the split text is evaluated once a text, not once a word.
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\s\p{Punct}]+", " ")), " ")
    none = F.array(F.lit(""))
    near = F.arrays_zip(words.alias("word"), F.concat(none, words).alias("before"), F.concat(F.slice(words, 2, 2**31 - 1), none).alias("after"))
    each = known.select("toxic", F.explode(near).alias("w"))
    each = each.select("toxic", F.col("w.word").alias("word"), F.xxhash64("w.before", "w.after").alias("context"))
    each = each.where(F.length("word") > 1).groupBy("word", "context")
    each = each.agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    words = each.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    marked = F.concat(F.lit("_"), "word", F.lit("_"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - 3)), lambda i: F.substring(marked, i, F.lit(4))))
    return words.withColumn("run", F.explode(runs)).select("run", "word", "t", "c")


def telling_runs(runs: DataFrame, setup: Training) -> list[str]:
    """The runs that toxic texts hold more often than their share of all runs, most surprising first."""
    counts = stored(runs.groupBy("run").agg(F.sum("t").alias("rt"), F.sum("c").alias("rc")).where(F.length("run") == 4), "runs")
    total = counts.agg(F.sum("rt").alias("t"), F.sum("rc").alias("c")).first()
    if not total["t"] or not total["c"]:
        return []
    share = total["t"] / (total["t"] + total["c"])
    expected = (F.col("rt") + F.col("rc")) * share
    counts = counts.withColumn("surprise", (F.col("rt") - expected) / F.sqrt(expected * (1 - share)))
    counts = counts.where(F.col("surprise") >= setup.least_surprise).orderBy(F.desc("surprise"), "run").limit(setup.runs)
    return [r["run"] for r in counts.select("run", "surprise").orderBy(F.desc("surprise"), "run").collect()]


def sentences_of(known: DataFrame, setup: Training) -> DataFrame:
    """(toxic, sentence): stretches of ``sentence_words`` words of the labelled texts, equal ones once."""
    n = setup.sentence_words
    words = known.select("toxic", F.posexplode(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\s\p{Punct}]+", " ")), " ")).alias("at", "word"), F.col("row"))
    each = words.groupBy("row", F.floor(F.col("at") / n).alias("part")).agg(F.max("toxic").alias("toxic"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    sentence = F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("sentence")
    return each.select("toxic", sentence).where(F.length("sentence") > 1).groupBy("sentence").agg(F.max("toxic").alias("toxic"))


def hardest(sentences: DataFrame, model: Model, toxic: int, n: int) -> list[str]:
    """The toxic or clean sentences with the largest word margins."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    def measure(batches) -> Iterator:
        for batch in batches:
            yield batch.assign(margin=shared.value.margins(batch["sentence"].tolist())[:, 0])

    some = sentences.where(F.col("toxic") == toxic).select("sentence").mapInPandas(measure, "sentence string, margin double")
    return [r["sentence"] for r in some.orderBy(F.desc("margin"), "sentence").limit(n).collect()]


def train(documents: DataFrame, labels: DataFrame, setup: Training = Training(), kernel: Kernel = Kernel()) -> Model:
    """Learn from at most ``setup.sample`` labelled texts that are not held out.

    The sample is the labels least in a hash of doc_id, so it does not depend on their order. Of rows that
    repeat a doc_id one is learned from, that with the greatest text, so the bound holds for rows too. Only the
    sample's ids are broadcast; words and runs are counted over the cluster, and a bounded number comes back.
    """
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(setup.sample)
    text = F.coalesce("text", F.lit("")).alias("text")
    labelled = documents.select("doc_id", text).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    known = stored(labelled.select("text", "toxic"), "labelled")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Model(kernel, None, constant=float(bool(counts.get(1))))
    runs = stored(run_counts(known), "words")
    telling = telling_runs(runs, setup)
    clean = [r["word"] for r in runs.where("c > t").select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(setup.landmarks - len(telling)).collect()]
    if not telling or not clean:
        return Model(kernel, None, constant=counts[1] / sum(counts.values()))
    sentences = stored(sentences_of(known.withColumn("row", F.monotonically_increasing_id()), setup), "sentences")
    at_random = lambda label: [r["sentence"] for r in sentences.where(F.col("toxic") == label).orderBy(F.xxhash64("sentence"), "sentence").limit(setup.sentences).select("sentence").collect()]
    features = Nystrom(telling, clean, kernel)
    toxic, clean = at_random(1), at_random(0)
    model = fit_sentences(features, toxic, clean, setup)
    # Once more with the sentences that matter: the clean ones nearest to toxic, and the most toxic with insertions.
    most = hardest(sentences, model, 1, setup.with_insertions)
    random = np.random.default_rng(setup.seed)
    toxic = list(dict.fromkeys(toxic + most)) + [with_insertion(s.split(), random) for s in most + most]
    clean = list(dict.fromkeys(clean + hardest(sentences, model, 0, setup.sentences)))
    model = fit_sentences(features, toxic, clean, setup)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            margins, levels = shared.value.margins_and_levels(batch["text"].tolist())
            yield pd.DataFrame({"margins": list(margins), "levels": list(levels), "toxic": batch["toxic"]})

    got = known.mapInPandas(measure, "margins array<double>, levels array<long>, toxic int").toPandas()
    y = got["toxic"].to_numpy(float)
    model.weigh(np.stack(got["levels"]), y)
    # Each text counts once whole and once with its most telling word alone, as toxic texts hardly ever have only one.
    margins = np.stack(got["margins"])
    alone = margins.copy()
    alone[:, 1:TOP] = FLOOR
    model.slopes, model.shift = fit_logistic(np.vstack([model.inputs(margins), model.inputs(alone)]), np.concatenate([y, y]))
    return model


def fit_sentences(features: Nystrom, toxic: list[str], clean: list[str], setup: Training) -> Model:
    """The SVM on labelled sentences, folded into a table."""
    phi = features.sentences(toxic + clean)
    beta, bias = fit_svm(phi, np.array([1.0] * len(toxic) + [-1.0] * len(clean)), setup.cost)
    return Model(features.kernel, features.table(beta), bias)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with score and predicted; only the text is an input of the score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of_text(texts):
        import pandas as pd

        return pd.Series(shared.value.scores(texts.fillna("").tolist()))

    scored = documents.withColumn("score", of_text(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not call toxic, with their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    return score(documents.select(whole, "text"), train(documents, labels)).where("predicted = 0").select("doc.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """Every whole text scored by a model that has not seen the held-out rows' labels."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity_kernel": op2}
