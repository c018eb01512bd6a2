"""Reading level of texts: regularised ordinal regression on features of words and sentences.

Word rarity comes from exact counts of all words of all documents. Only the words with a share of at least ``HEAD`` of
all words are sent to the tasks, of which there cannot be more than 1 / HEAD, whatever the corpus; all others are equally rare.
The regression is fitted on a bounded sample of human ratings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.language import FUNCTION_WORDS
from folioflow.session import cut, spread

#: The least share of all words of a word in the head (at most 500,000 words), and ratings that the regression is fitted on at most.
HEAD, RATINGS = 2e-6, 50_000
LEVELS = 5
#: Words counted by a task before it passes the counts on.
_FLUSH = 200_000
# Connectives by language.
CONNECTIVES = {
    "en": "because although though whereas while unless since therefore however moreover furthermore consequently hence thus nevertheless nonetheless notwithstanding otherwise meanwhile insofar thereby whereby whether even",
    "de": "weil obwohl während wenn sodass damit deshalb daher jedoch außerdem folglich demnach dennoch sondern insofern ungeachtet somit indem sofern selbst daraus",
    "fr": "parce puisque quoique tandis lorsque donc cependant toutefois ainsi néanmoins pourtant afin mesure nonobstant bien dès",
    "es": "porque aunque mientras cuando pues puesto entonces embargo así tanto además luego obstante medida aun",
}
# Words that open a clause inside another, by language; of those in the second list only where a comma stands before.
SUBORDINATORS = {
    "en": "that which who whom whose where when if than because although though whereas while unless since whether",
    "de": "dass weil obwohl während wenn sodass damit indem sofern ob wobei wodurch worin welcher welche welches welchem welchen",
    "fr": "que qui dont où quand si lequel laquelle lesquels lesquelles parce puisque quoique lorsque",
    "es": "que quien cual cuya cuyo donde si cuando porque aunque mientras",
}
AFTER_COMMA = {"de": "der die das dem den deren dessen denen was wo wie als"}
_LANGS = tuple(CONNECTIVES)
_FUNCTION = {lang: FUNCTION_WORDS[lang].split() for lang in _LANGS}
_CONNECTIVES = {lang: frozenset(words.split()) for lang, words in CONNECTIVES.items()}


def _kept(chars: str, **other: str) -> bytes:
    """A table of bytes: letters, ``chars`` and all beyond ASCII stay, ``other`` changes, the rest is a space."""
    stay = {c for c in map(chr, range(128)) if c.isalpha()} | set(chars)
    return bytes(ord(other.get(c, c if c in stay or i > 127 else " ")) for i, c in enumerate(map(chr, range(256))))


# Patterns begin with a set of characters, so that a search passes over all others at once.
_LETTERS, _TOKENS = _kept(""), _kept("0123456789_,\0", **{";": ",", "\n": "\1"})
_GAP, _DIGIT, _FOREIGN = re.compile(r"[^\w\x00-\x7f]"), re.compile(r"\d"), re.compile(r"[^\x00-\x7f]")
_SENTENCE_END = re.compile(r"[.!?…](?<![.!?…]{2})[.!?…]*+(?=[\s\"'»”)]|$)")
_UNIT = re.compile(r"[.!?…\n](?:(?<=\n)\n*+|(?<![.!?…]{2})[.!?…]*+[\s\"'»”)])")
_RELATIVE = {lang: re.compile(f",\\s+(?:{'|'.join(words.split())})\\b") for lang, words in AFTER_COMMA.items()}
_OPENS, _CLOSES, _LINE, _MARK = 1, 2, 3, 4
_CLAUSES = {lang: {**dict.fromkeys(words.split(), _OPENS), ",": _CLOSES, "\1": _LINE, "\0": _MARK} for lang, words in SUBORDINATORS.items()}
_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûëïœæ]+")
FEATURES = (
    "log_words", "word_length", "long_words", "syllables", "log_unit_length", "longest_unit", "diversity", "window_diversity", "rarity", "rare_words",
    "very_rare_words", "connectives", "subordinators", "commas", "semicolons", "clause_depth", "deepest_clause", "digits", "capitals", "short_words", "questions",
)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_in(low: str) -> list[str]:
    """The runs of letters, in order: what ``[^\\W\\d_]+`` finds."""
    plain = _bytes(low).translate(_LETTERS).decode("utf-8", "surrogatepass")
    return (plain if plain.isascii() else _DIGIT.sub(" ", _GAP.sub(" ", plain))).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(words_in(text.lower()))
        if len(seen) > _FLUSH:
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
    yield pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64())})


class Words:
    """The counts of the most frequent words, and of all words together."""

    def __init__(self, counts: dict[str, int], total: int):
        self.counts, self.total = counts, float(max(total, 1))

    def rarity(self, word: str) -> float:
        """-log10 of the word's share of all words; of words beyond the head, that of one just rarer than it."""
        return -math.log10(max(self.counts.get(word, 0) / self.total, HEAD / 2))


def count_words(documents: DataFrame, text_col: str = "text") -> Words:
    """Exact counts over all texts, of which the head reaches the driver."""
    parts = spread(documents.select(F.col(text_col).cast("string"))).mapInArrow(_count, "word string, n long")
    counts = cut(parts.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    head = counts.where(F.col("n") >= HEAD * total).toArrow()
    return Words(dict(zip(head.column("word").to_pylist(), head.column("n").to_pylist())), total)


def language_of(counts: Counter) -> str | None:
    """The language with most function words among the counted words; None without any."""
    hits = {lang: sum(map(counts.get, words, repeat(0))) for lang, words in _FUNCTION.items()}
    best = max(hits, key=hits.__getitem__)
    return best if hits[best] else None


def clause_depths(low: str, lang: str | None) -> tuple[int, list[int]]:
    """(subordinators, greatest depth of nesting per sentence): a proxy for clauses inside clauses.

    A subordinating word opens a clause inside the one it stands in; a comma or semicolon ends the innermost open one (a comma that a
    relative pronoun follows opens the next instead); a sentence mark or line end ends all.
    """
    if lang is None:
        return 0, []
    if lang in _RELATIVE:  # such a pair opens a clause as a subordinator does; the dash keeps a mark before the comma from ending a sentence
        low = _RELATIVE[lang].sub(f"- {SUBORDINATORS[lang].split()[0]} ", low)
    marked = _bytes(_SENTENCE_END.sub("\0", low.replace("\0", "-")))
    plain = marked.translate(_TOKENS).replace(b",", b" , ").replace(b"\1", b" \1 ").replace(b"\0", b" \0 ").decode("utf-8", "surrogatepass")
    tokens = (plain if plain.isascii() else _GAP.sub(" ", plain)).split()
    found, depths, depth, most = 0, [], 0, 0
    for what in filter(None, map(_CLAUSES[lang].get, tokens)):
        if what == _OPENS:
            found += 1
            depth += 1
            most = max(most, depth)
        elif what == _CLOSES:
            depth -= depth > 0
        else:
            if most or what == _MARK:
                depths.append(most)
            depth = most = 0
    if most:
        depths.append(most)
    return found, depths


def _those(text: str, ascii_: bytes, test) -> int:
    """How many characters are of one kind: ``ascii_`` lists those of ASCII, ``test`` tells the others."""
    data = _bytes(text)
    return len(data) - len(data.translate(None, ascii_)) + (0 if text.isascii() else sum(map(test, _FOREIGN.findall(text))))


def features_of(text: str | None, words_: Words, cache: dict[str, tuple]) -> list[float] | None:
    """The features in the order of ``FEATURES``; None for a text without words."""
    low = (text or "").lower()
    words = words_in(low)
    n = len(words)
    if not n:
        return None
    counts = Counter(words)
    lang = language_of(counts)
    length = syllables = rarity = 0.0
    long_ = short = rare = very = 0
    for word, k in counts.items():
        f = cache.get(word)
        if f is None:
            if len(cache) > 500_000:
                cache.clear()
            f = cache[word] = (len(word), max(1, len(_VOWELS.findall(word))), words_.rarity(word))
        length += f[0] * k
        syllables += f[1] * k
        rarity += f[2] * k
        if f[0] >= 8:
            long_ += k
        elif f[0] <= 3:
            short += k
        if f[2] > 4:
            rare += k
            if f[2] > 5:
                very += k
    connectives = sum(counts[w] for w in _CONNECTIVES[lang] if w in counts) if lang else 0
    subordinators, depths = clause_depths(low, lang)
    units = [s.count(" ") + 1 for s in _UNIT.split(text) if s and not s.isspace()]
    m = max(1, len(units))
    windows = [*range(0, max(1, n - 49), 50), *([n - 50] if n > 50 and n % 50 else [])]  # the last one ends with the text
    window = sum(len(set(words[i : i + 50])) / min(50, n - i) for i in windows) / len(windows)
    commas, semicolons = text.count(","), text.count(";") + text.count(":") + text.count("—") + text.count("(")
    return [
        math.log(n), length / n, long_ / n, syllables / n, math.log(n / m), math.log(max(units, default=1)), math.log(len(counts) + 1) / math.log(n + 1), window, rarity / n, rare / n,
        very / n, connectives / m, subordinators / m, commas / m, semicolons / m, sum(depths) / max(1, len(depths)), max(depths, default=0), _those(low, b"0123456789", str.isdigit) / len(low),
        _those(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", str.isupper) / max(len(text), 1), short / n, text.count("?") / m,
    ]


def as_lists(rows: list[list[float] | None]) -> pa.ListArray:
    """Rows of equally many doubles, or null, as a column: flat, since Arrow converts nested Python lists slowly."""
    missing = np.array([r is None for r in rows], dtype=bool)
    flat = np.array([r for r in rows if r is not None], dtype=float)
    ends = np.concatenate([[0], np.cumsum(~missing)]) * (flat.shape[1] if len(flat) else 0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.ravel(), pa.float64()), mask=pa.array(missing))


def features(documents: DataFrame, words: Words, keep: list[str]) -> DataFrame:
    """``doc_id``, ``keep`` and ``features`` (null for texts without words) of each document."""
    narrow = documents.select("doc_id", *keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", features array<double>"
    ref = documents.sparkSession.sparkContext.broadcast((words.counts, words.total))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cache = Words(*ref.value), {}
        for batch in batches:
            rows = [features_of(t, held, cache) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], as_lists(rows)], names=[*batch.schema.names[:-1], "features"])

    return spread(narrow).mapInArrow(measure, schema)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def probabilities(x: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(level = 1..LEVELS) of the proportional-odds model, one row per row of x."""
    below = _sigmoid(cuts[None, :] - (x @ weights)[:, None])
    edges = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
    return np.maximum(np.diff(edges, axis=1), 1e-9)


def fit_ordinal(x: np.ndarray, levels: np.ndarray, ridge: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by gradient descent with momentum on the penalised likelihood; cuts stay ordered."""
    n, d = x.shape
    weights = np.zeros(d)
    share = np.clip(np.cumsum(np.bincount(levels - 1, minlength=LEVELS)[:-1]) / max(n, 1), 0.01, 0.99)
    start = np.log(share / (1 - share))
    params = np.concatenate([weights, [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        w, c0, gaps = params[:d], params[d], np.exp(params[d + 1 :])
        cuts = c0 + np.concatenate([[0], np.cumsum(gaps)])
        score = x @ w
        edges = np.concatenate([[-40.0], cuts, [40.0]])
        up, down = _sigmoid(edges[levels] - score), _sigmoid(edges[levels - 1] - score)
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        grad_w = -(x.T @ (dd - du)) / n + ridge * w
        grad_edges = np.zeros(LEVELS + 1)
        np.add.at(grad_edges, levels, -du / n)
        np.add.at(grad_edges, levels - 1, dd / n)
        grad_cuts = grad_edges[1:LEVELS]
        tail = np.cumsum(grad_cuts[::-1])[::-1]
        grad = np.concatenate([grad_w, [tail[0]], tail[1:] * gaps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        params = params - 0.03 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cuts = params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])
    return params[:d], cuts


class Model:
    """Feature means and spreads over all documents, weights, cuts."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.mean, self.spread, self.weights, self.cuts = mean, spread, weights, cuts

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def estimate(self, x: np.ndarray) -> np.ndarray:
        return probabilities(self.scaled(x), self.weights, self.cuts)


def train(measured: DataFrame, labels: DataFrame, ratings: int = RATINGS) -> Model:
    """Fit on at most ``ratings`` ratings, the first in the order of a hash of document and rater.

    Means and spreads are over all documents. Without any rating all levels are equally likely.
    """
    d = len(FEATURES)
    stats = measured.where("features is not null").agg(
        *[F.avg(F.element_at("features", i + 1)).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.element_at("features", i + 1)).alias(f"s{i}") for i in range(d)]
    ).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    spread = np.array([max(stats[f"s{i}"] or 0.0, 1e-6) for i in range(d)])
    given = labels.where(F.col("level").between(1, LEVELS)).select("doc_id", "rater", "level").dropDuplicates()
    rated = measured.where("features is not null").select("doc_id", "features").join(given, "doc_id")
    rows = rated.orderBy(F.xxhash64("doc_id", "rater")).limit(ratings).select("features", "level").toArrow()
    model = Model(mean, spread, np.zeros(d), np.array([math.log(k / (LEVELS - k)) for k in range(1, LEVELS)]))
    if len(rows):
        x = np.array(rows.column("features").to_pylist(), dtype=float)
        model.weights, model.cuts = fit_ordinal(model.scaled(x), rows.column("level").to_numpy().astype(int))
    return model


def estimates(measured: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """doc_id, ``keep``, reading_level (1..5, the median level), expected_level and confidence.

    A text without words gets the estimate of an average text, with confidence 0.
    """
    narrow = measured.select("doc_id", *keep, "features")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", reading_level int, expected_level double, confidence double"

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(batch.num_columns - 1)
            if not len(given):
                continue
            known = given.is_valid().to_numpy(zero_copy_only=False)
            x = np.tile(model.mean, (len(given), 1))
            x[known] = given.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model.mean))
            p = model.estimate(x)
            level = 1 + (np.cumsum(p, axis=1) < 0.5).sum(axis=1)
            columns = [*batch.columns[:-1], pa.array(level, pa.int32()), pa.array(p @ np.arange(1, LEVELS + 1)), pa.array(p.max(axis=1) * known)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "reading_level", "expected_level", "confidence"])

    return narrow.mapInArrow(guess, schema)


def levels(documents: DataFrame, labels: DataFrame, ratings: int = RATINGS) -> DataFrame:
    """doc_id, source, lang, reading_level, expected_level, confidence: one row per row of ``documents``."""
    measured = cut(features(documents, count_words(documents), ["source", "lang"]))
    return estimates(measured, train(measured, labels, ratings), ["source", "lang"])


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source and lang: documents, mean expected level, and how many have each level."""
    rows = levels(documents, labels)
    counts = [F.count_if(F.col("reading_level") == k).alias(f"level_{k}") for k in range(1, LEVELS + 1)]
    return rows.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.avg("expected_level").alias("mean_level"), *counts)


def accuracy(documents: DataFrame, labels: DataFrame, ratings: int = RATINGS) -> DataFrame:
    """Per lang and rated level: ratings held out from the fit, and how near the estimates come: share right, mean error, mean estimate.

    Every fifth document by a hash of its id is held out with all its ratings; the model is fitted on the others.
    """
    measured = cut(features(documents, count_words(documents), ["lang"]))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = train(measured, labels.where(~held), ratings)
    given = labels.where(held & F.col("level").between(1, LEVELS)).select("doc_id", "rater", "level").dropDuplicates().select("doc_id", "level")
    rows = estimates(measured.where(held), model, ["lang"]).join(given, "doc_id")
    return rows.groupBy("lang", "level").agg(
        F.count("*").alias("ratings"), F.avg((F.col("reading_level") == F.col("level")).cast("double")).alias("right_share"),
        F.avg(F.abs(F.col("reading_level") - F.col("level"))).alias("mean_error"), F.avg("expected_level").alias("mean_estimate"),
    )
