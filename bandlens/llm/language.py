"""The language of each line of a text and of passages within it, with a confidence.

Model: a word is the sum of hashed embeddings of its subwords (the word itself and its 2- to
5-letter pieces, lower case, without accents, in 2^18 buckets); a passage is the average over its
subwords, and a linear softmax gives the languages. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled documents (by default the 120
of each language that come first by a hash of the id). Labels may be wrong and texts mixed: lines
whose label is unlikely to a model of other documents are left out first.

Calibration: every tenth document is held out of all training, and its labels stay as they are. On
pieces of their lines, as short as a passage may be, the softmax's temperature is fitted by likelihood, together with the share of labels
that are wrong (a label is the softmax's with one chance and any language with the other), so that
confidences are those of the text's language and not of its label. A passage is rejected (has no
language) if its lead is below the margin: the lead that all but a stated share (``REJECTED``) of the
rightly labelled pieces reach. The share is smaller than one of the held-out pieces, so it is taken from
a normal distribution with their median and lower deviation.

As all is linear before the softmax, a word's part in a passage's score is one vector, which a
worker computes once for each word it meets. A text is cut into lines (at line feeds) and lines into
segments (at sentence ends, brackets and quotation marks); a segment's language is found by a
Viterbi pass over the line, so that names and numbers take their neighbours' language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandlens.plans.ship import ship

LANGUAGES = ("en", "fr", "de", "es", "pt", "nl", "sv", "pl")
#: ISO codes of two and three letters and English names.
NAMES = {
    "en": ("en", "eng", "english"),
    "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "sv": ("sv", "swe", "swedish"),
    "pl": ("pl", "pol", "polish"),
}
BUCKETS, DIMENSIONS = 2**18, 16
#: Steps of the gradient descent (64 lines each); more change nothing on held-out documents (README).
STEPS = 400
#: Every so many-th document is held out; the share of its right lines that the margin may reject; what a unit of logits weighs in a segment of 40 subwords.
HELD, REJECTED, EVIDENCE = 10, 1e-4, 20.0
#: A bound on the labelled documents the model is fitted on, for each language.
LABELLED = 120
#: Longer texts are not trained on (the driver holds the sample).
LONGEST = 100_000
#: Parts of the labelled documents that are judged by a model of the others; the leads in logits from which a label is
#: doubted and replaced.
FOLDS, DOUBT, SURE = 3, 2.0, 1.0
#: Words in a row that make a passage.
IN_A_ROW = 8
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_OPENS = "([{«“„‹\"¿¡‘‚"
_CLOSES = re.compile(r"[.!?…][)\]}»”“›\"’']*\r?$|[)\]}»”›\"]+[.,;:!?]*\r?$|\r$")


def named_language(column: str):
    """The language that a label names, as a column; null where it names none."""
    first = F.regexp_extract(F.lower(F.trim(F.col(column))), r"^([a-z]+)(?:[-_].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(first.isin(*names), F.lit(lang)).otherwise(out)
    return out


def plain(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss")


def buckets(word: str) -> list[int]:
    """The subwords' buckets of a word, by their CRC-32; none if it has no letters."""
    out = []
    for w in _WORD.findall(plain(word)):
        w = f"<{w}>"
        grams = {w, *(w[i : i + n] for n in (2, 3, 4, 5) for i in range(len(w) - n + 1))} if len(w) <= 40 else {w[i : i + 4] for i in range(len(w) - 3)}
        out += [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]
    return out


def _has_word(part: str) -> bool:
    return any(c.isalnum() for c in part)


class Model:
    """Trained parts: for each bucket a vector of logits, the bias, the temperature (as a factor), the margin; and what held-out documents say (``held``)."""

    def __init__(self, vectors: np.ndarray, bias: np.ndarray, scale: float, margin: float, held: dict | None = None) -> None:
        self.vectors, self.bias, self.scale, self.margin, self.held = vectors, bias, scale, margin, held or {}


class _Lines:
    """Lines as codes of words, words as buckets (CSR)."""

    def __init__(self, lines: list[str]) -> None:
        vocabulary: dict[str, int] = {}
        self.words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in line.split()], np.int64) for line in lines]
        grams = [buckets(w) for w in vocabulary]
        self.counts = np.array([len(g) for g in grams], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.grams = np.array([b for g in grams for b in g], np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows that end before ``ends``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _flat(data: _Lines, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lines, and the line's place of each."""
    words = np.concatenate([data.words[r] for r in rows])
    line = np.repeat(np.arange(len(rows)), [len(data.words[r]) for r in rows])
    counts = data.counts[words]
    at = np.repeat(data.starts[words] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return data.grams[at], np.repeat(line, counts)


def _descend(data: _Lines, labels: np.ndarray, rows: np.ndarray, seed: int, steps: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias after so many steps; the rate falls linearly to 0, and rare languages are drawn more often."""
    rng = np.random.default_rng(seed)
    k = len(LANGUAGES)
    embed = np.zeros((BUCKETS, DIMENSIONS), np.float32)  # subwords that are never met say nothing
    weights, bias = rng.normal(0, 0.6, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, np.float32)
    own = [rows[labels[rows] == i] for i in range(k)]
    queues = [np.zeros(0, np.int64) for _ in range(k)]
    present = [i for i in range(k) if len(own[i])]
    # Rare languages are drawn more often than they occur: by the roots of the numbers of their lines.
    odds = np.sqrt([len(own[i]) for i in present])
    each = {i: max(2, round(batch * o)) for i, o in zip(present, odds / odds.sum(), strict=True)}
    for step in range(steps):
        some = []
        for i in present:
            while len(queues[i]) < each[i]:
                queues[i] = np.concatenate([queues[i], rng.permutation(own[i])])
            some.append(queues[i][: each[i]])
            queues[i] = queues[i][each[i] :]
        some = np.concatenate(some)
        grams, line = _flat(data, some)
        if not len(grams):
            continue
        rate = 1 - step / steps
        unique, inverse = np.unique(grams, return_inverse=True)
        n = np.maximum(np.bincount(line, minlength=len(some)), 1).astype(np.float32)
        # The counts matrix (lines x buckets of the batch) makes both directions dense products.
        counts = np.bincount(line * len(unique) + inverse, minlength=len(some) * len(unique)).reshape(len(some), -1).astype(np.float32) / n[:, None]
        mean = counts @ embed[unique]
        p = mean @ weights + bias
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(some)), labels[some]] -= 1
        g = p / len(some)
        back = counts.T @ (g @ weights.T)
        weights -= rate * 0.5 * (mean.T @ g)
        bias -= rate * 0.05 * g.sum(0)
        embed[unique] -= rate * 100.0 * back
    return embed, weights, bias


def _logits(data: _Lines, rows: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, line = _flat(data, rows)
    n = np.bincount(line, minlength=len(rows))
    return _sums(vectors[grams], np.cumsum(n)) / np.maximum(n, 1)[:, None] + bias, n


def train(documents: list[tuple[str, str]], seed: int = 0, steps: int = STEPS, rejected: float = REJECTED) -> Model:
    """Fit on (text, language) pairs; without any, every passage is rejected."""
    lines, labels, of = [], [], []
    for d, (text, lang) in enumerate(documents):
        for line in text.split("\n"):
            words = line.split()
            # Long lines as pieces, so that lengths are like those of sentences; held-out ones as the shortest passages that count.
            most, least = (IN_A_ROW, IN_A_ROW) if d % HELD == HELD - 1 else (24, 4)
            for a in range(0, len(words), most):
                if len(words) - a >= least:
                    lines.append(" ".join(words[a : a + most]))
                    labels.append(LANGUAGES.index(lang))
                    of.append(d)
    if len(set(labels)) < 2:
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 1.0, np.inf)
    data, given, of = _Lines(lines), np.array(labels), np.array(of)
    held = of % HELD == HELD - 1
    if len(set(given[~held])) < 2:
        held[:] = False
    y, own = given.copy(), np.flatnonzero(~held)
    # Documents are mixed or wrongly labelled: a line whose label is unlikely to a model that has not seen its document is left out.
    keep = ~held
    for f in range(FOLDS):
        seen, judged = own[of[own] % FOLDS != f], own[of[own] % FOLDS == f]
        if len(set(y[seen])) < 2:
            continue
        embed, weights, bias = _descend(data, y, seen, seed, steps // 2)
        vectors = embed @ weights
        for some in np.array_split(judged, len(judged) // 2000 + 1):
            z, _ = _logits(data, some, vectors, bias)
            keep[some] = (z[np.arange(len(some)), y[some]] >= z.max(1) - DOUBT) | ~np.isin(y[some], y[seen])
    rows = np.flatnonzero(keep)
    if len(set(y[rows])) < 2:
        rows = own
    embed, weights, bias = _descend(data, y, rows, seed, steps)
    vectors = embed @ weights
    # Once more, with all lines but the held-out ones: those of whose language the model is sure have that one, whatever their label.
    for some in np.array_split(own, len(own) // 2000 + 1):
        z, _ = _logits(data, some, vectors, bias)
        top = np.sort(z, axis=1)
        sure = top[:, -1] - top[:, -2] >= SURE
        keep[some] = sure | (z.argmax(1) == y[some])
        y[some] = np.where(sure, z.argmax(1), y[some])
    embed, weights, bias = _descend(data, y, np.flatnonzero(keep), seed, steps)
    vectors = embed @ weights
    scale, margin, said = 4.0, 1.0, {}
    test = np.flatnonzero(held)
    if len(test) > 20:
        z = np.concatenate([_logits(data, some, vectors, bias)[0] for some in np.array_split(test, len(test) // 2000 + 1)])
        scale, wrong = temperature(z, given[test])
        right = z.argmax(1) == given[test]
        lead = z.max(1) - z.mean(1)
        if right.any():
            middle, low = np.quantile(lead[right], [0.5, 0.159])
            margin = float(max(0.0, middle + NormalDist().inv_cdf(rejected) * (middle - low)))
        said = reliability(z, given[test], scale, margin) | {"wrong_labels": wrong}
    return Model(vectors.astype(np.float32), bias.astype(np.float32), scale, margin, said)


def temperature(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(factor of the logits, share of random labels) of the largest likelihood of the labels."""
    best, out, k = np.inf, (1.0, 0.0), z.shape[1]
    for s in np.geomspace(0.25, 64, 65):
        e = np.exp(s * (z - z.max(1, keepdims=True)))
        p = e[np.arange(len(z)), labels] / e.sum(1)
        for wrong in (0.0, *np.geomspace(0.001, 0.5, 40)):
            loss = -np.log(np.maximum((1 - wrong) * p + wrong / k, 1e-300)).mean()
            if loss < best:
                best, out = loss, (float(s), float(wrong))
    return out


def reliability(z: np.ndarray, labels: np.ndarray, scale: float, margin: float, bins: tuple = (0.0, 0.5, 0.9, 0.99, 0.999, 1.0)) -> dict:
    """Held-out lines by language (lines, recall, precision) and by confidence (lines, mean confidence, share that agrees with the label); rejected ones have no language."""
    e = np.exp(scale * (z - z.max(1, keepdims=True)))
    p = e.max(1) / e.sum(1)
    found = np.where(z.max(1) - z.mean(1) >= margin, z.argmax(1), -1)
    by = {}
    for i, lang in enumerate(LANGUAGES):
        hit, n, got = ((found == i) & (labels == i)).sum(), (labels == i).sum(), (found == i).sum()
        by[lang] = (int(n), float(hit / max(n, 1)), float(hit / max(got, 1)))
    table, agree = [], z.argmax(1) == labels
    for a, b in zip(bins, bins[1:], strict=False):
        own = (p >= a) & ((p < b) | (b == 1.0))
        table.append((a, b, int(own.sum()), float(p[own].mean()) if own.any() else 0.0, float(agree[own].mean()) if own.any() else 0.0))
    return {"languages": by, "bins": table, "rejected": float((found < 0).mean())}


class _Words(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class Detector:
    """Finds the languages of lines; keeps what it has computed for the words it met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.scores = np.zeros((0, len(LANGUAGES)), np.float32)
        self.facts = np.zeros((0, 5), np.int32)  # buckets, words, opens, closes, is a line feed
        self.words["\n"]  # noqa: B018
        self.learn()

    def learn(self) -> None:
        new, self.words.new = self.words.new, []
        grams = [buckets(w) for w in new]
        counts = np.array([len(g) for g in grams], np.int64)
        flat = np.array([b for g in grams for b in g], np.int64)
        sums = _sums(self.model.vectors[flat], np.cumsum(counts)) if len(new) else np.zeros((0, len(LANGUAGES)))
        facts = [(n, sum(map(_has_word, w.split())), w[:1] in _OPENS and w[:1] != "", bool(_CLOSES.search(w)), w == "\n") for n, w in zip(counts, new, strict=True)]
        self.scores = np.concatenate([self.scores, sums.astype(np.float32)])
        self.facts = np.concatenate([self.facts, np.array(facts, np.int32).reshape(-1, 5)])

    def segments(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """For each segment of all texts: text, line, logits, subwords, words."""
        if len(self.words) > REMEMBERED:
            self.forget()
        code = self.words.__getitem__
        parts = [np.fromiter(map(code, (t or "").replace("\n", " \n ").split(" ")), np.int64) for t in texts]
        if self.words.new:
            self.learn()
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), lengths)
        facts = self.facts[codes]
        feed = facts[:, 4] == 1
        feeds = np.cumsum(feed)
        first = np.cumsum(lengths) - lengths
        line = feeds - np.repeat(feeds[first] if len(codes) else first, lengths)  # the first part of a text is never a line feed
        begin = (facts[:, 2] == 1) | feed
        begin[1:] |= (facts[:-1, 3] == 1) | feed[:-1]
        begin[first] = True
        at = np.flatnonzero(begin)
        kept = ~feed[at]
        sums = np.add.reduceat(self.scores[codes], at, axis=0) if len(at) else np.zeros((0, len(LANGUAGES)))
        numbers = np.add.reduceat(facts[:, :2], at, axis=0) if len(at) else np.zeros((0, 2), np.int32)
        return {"text": text[at][kept], "line": line[at][kept], "sums": sums[kept], "grams": numbers[kept, 0], "words": numbers[kept, 1]}

    def labelled(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """For each passage (segments of a line in a row of one language, or of none): text, line, lang (-1: none), words, confidence."""
        s = self.segments(texts)
        n, k = len(s["text"]), len(LANGUAGES)
        grams = np.maximum(s["grams"], 1)[:, None]
        # A segment's evidence: its mean logits, centred, weighted by its length (up to that of a short sentence).
        mean = s["sums"] / grams + self.model.bias
        weight = np.minimum(s["grams"], 150)[:, None] / 40
        # Having no language is one more state: what the best language must reach, and a little for segments without letters.
        none = np.minimum(self.model.margin, 1e6) * weight * EVIDENCE + 1.0
        evidence = np.concatenate([(mean - mean.mean(1, keepdims=True)) * weight * EVIDENCE, none], axis=1)
        lang = self.viterbi(s["text"], s["line"], evidence)
        same = np.ones(n, bool)
        same[1:] = (s["text"][1:] == s["text"][:-1]) & (s["line"][1:] == s["line"][:-1]) & (lang[1:] == lang[:-1])
        same[:1] = False
        at = np.flatnonzero(~same)
        if not n:
            return {"text": s["text"], "line": s["line"], "lang": lang, "words": s["words"], "confidence": np.zeros(0)}
        sums, grams = np.add.reduceat(s["sums"], at, axis=0), np.maximum(np.add.reduceat(s["grams"], at), 1)
        z = (sums / grams[:, None] + self.model.bias) * self.model.scale
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        found = lang[at]
        confidence = np.where(found < k, p[np.arange(len(at)), np.minimum(found, k - 1)], 0.0)
        return {"text": s["text"][at], "line": s["line"][at], "lang": np.where(found < k, found, -1), "words": np.add.reduceat(s["words"], at), "confidence": confidence}

    @staticmethod
    def viterbi(text: np.ndarray, line: np.ndarray, evidence: np.ndarray, switch: float = 3.0) -> np.ndarray:
        """The best state of each segment; ``switch`` is the price of a change within a line. All lines advance together."""
        n, k = evidence.shape
        if not n:
            return np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, n))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        back = np.zeros((n, k), np.int8)
        score = evidence[start].astype(np.float64)
        longest = int(length[0])
        alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        for j in range(1, longest):
            m = alive[j]
            prev = score[:m]
            best = prev.argmax(1)
            jump = prev[np.arange(m), best] - switch
            stay = prev >= jump[:, None]
            at = start[:m] + j
            back[at] = np.where(stay, np.arange(k), best[:, None])
            score[:m] = np.where(stay, prev, jump[:, None]) + evidence[at]
        out = np.zeros(n, np.int64)
        state = score.argmax(1)
        for j in range(longest - 1, -1, -1):
            m = alive[j]
            at = start[:m] + j
            out[at] = state[:m]
            if j:
                state[:m] = back[at, state[:m]]
        return out


_detectors: dict[int, Detector] = {}


def _worker(model) -> Detector:
    value = model.value
    if id(value) not in _detectors:
        _detectors.clear()
        _detectors[id(value)] = Detector(value)
    return _detectors[id(value)]


def training_documents(df: DataFrame, key: str, text: str, lang: str, labelled: int = LABELLED) -> DataFrame:
    """At most ``labelled`` labelled texts of each language: the first by a hash of their id."""
    some = df.select(F.col(text).alias("text"), named_language(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k"))
    some = some.filter(f"lang is not null and length(text) between 40 and {LONGEST}")
    keys = some.select("lang", "h", "k").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))).filter(F.col("rn") <= labelled)
    return some.join(F.broadcast(keys.drop("rn")), ["lang", "h", "k"], "left_semi").select("text", "lang")


def detect_languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", labelled: int = LABELLED, seed: int = 0, steps: int = STEPS, rejected: float = REJECTED) -> DataFrame:
    """Each line's passages: ``key``, ``para_no`` (from 0, empty lines counted), ``passage_no``, ``language``, ``n_words``, ``confidence``, ``named`` (the label's language or null).

    ``language`` is null for passages that are rejected: names, numbers, other scripts, empty lines. An
    empty text has one empty line; a null text has none. Rows are treated one by one, so repeated rows
    give repeated results; extra columns are ignored. Without labelled texts of two languages every
    passage is rejected. Only training uses a sample; detection covers whole texts of any length.
    """
    ship(df.sparkSession)
    sample = training_documents(df, key, text, lang, labelled).orderBy("lang", "text").collect()
    model = df.sparkSession.sparkContext.broadcast(train([(r.text, r.lang) for r in sample], seed, steps, rejected))

    def run(batches):
        from bandlens.llm.encode import _blocks

        names = np.array([*LANGUAGES, None], dtype=object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            detector = _worker(model)
            for a, b in _blocks(texts, 2_000_000):
                found = detector.labelled(texts[a:b])
                keep = np.array([t is not None for t in texts[a:b]], bool)[found["text"]] if b > a else np.zeros(0, bool)
                found = {c: v[keep] for c, v in found.items()}
                rows = found["text"] + a
                line_start = np.ones(len(rows), bool)
                line_start[1:] = (rows[1:] != rows[:-1]) | (found["line"][1:] != found["line"][:-1])
                place = np.arange(len(rows)) - np.maximum.accumulate(np.where(line_start, np.arange(len(rows)), 0))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), pa.array(found["line"], pa.int32()), pa.array(place, pa.int32()),
                        pa.array(names[found["lang"]].tolist(), pa.string()), pa.array(found["words"], pa.int32()),
                        pa.array(found["confidence"], pa.float64()), batch.column(2).take(take),
                    ],
                    names=["key", "para_no", "passage_no", "language", "n_words", "confidence", "named"],
                )

    schema = T.StructType([
        T.StructField("key", df.schema[key].dataType), T.StructField("para_no", T.IntegerType()), T.StructField("passage_no", T.IntegerType()),
        T.StructField("language", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("named", T.StringType()),
    ])
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text"), named_language(lang).alias("named")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def wrong_languages(passages: DataFrame, key: str = "doc_id", in_a_row: int = IN_A_ROW) -> DataFrame:
    """``key``, ``para_no``, ``lang``: lines with a passage of ``in_a_row`` words whose language the label does not name."""
    return (
        passages.filter(F.col("language").isNotNull() & (F.col("n_words") >= in_a_row) & (F.col("named").isNull() | (F.col("named") != F.col("language"))))
        .select(key, "para_no", F.col("language").alias("lang"))
        .distinct()
    )
