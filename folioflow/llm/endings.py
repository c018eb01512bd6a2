"""Ending evidence: can a text end with this word, or was it cut there?

Both hypotheses are measured over all texts. A complete text ends with a word as often as sentences
end with it. A cut falls at any position of running text, so what stands before the cut is either a
word inside a sentence or the beginning of a longer word. The log-likelihood ratio of the two is kept
per token; it needs counts of words, of sentence ends and of word beginnings only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = "\"'`«»“”„‘’()[]{}<>*_¿¡.,;:!?…|#-–—"
_END = re.compile(r"[.!?…。]+[\"'»”’)\]*_`]*$")
_MARK = re.compile(r"\s*(?:\.\.\.|…|\[(?:truncated|cut|continued|\.\.\.)\]|\((?:truncated|cut|continued)\)|<(?:truncated|cut)>|�)+$", re.I)
_LETTERS = re.compile(r"(?:^|[\s:])[A-Z]\.?(?:\s*[,;/]\s*[A-Z]\.?)+$|(?:\b\d+\s*[-.:)=]\s*[A-Za-z]\b[\s,;]*){2,}$")
_DIGITS = re.compile(r"\d+")
_OPEN_END = re.compile(r"[,;:(\[{«„“¿¡/&+=–—-]$")
_CLOSED_END = re.compile(r"[\"'»”’)\]}*_`>%€$°]$")
# Articles, conjunctions and prepositions that no sentence ends with unless it was cut there.
HANGING = frozenset(
    "the a an and or but because although whereas which of than if unless while nor so-that whose every"
    " der das dem des und oder aber weil obwohl sodass dass wenn von für zum zur beim ein eine einen einem einer"
    " le les des du un une et ou mais parce que qui dont pour car lorsque chez"
    " el los las del una y o pero porque aunque con por"
    " il gli della che perché dos das pelo het een omdat maar".split()
)
_WORDY = re.compile(r"\w")
_cores: dict[str, str] = {}


def core(raw: str) -> str:
    """A white-space token without its punctuation, in lower case, digits made alike."""
    found = _cores.get(raw)
    if found is None:
        if len(_cores) > 500_000:
            _cores.clear()
        found = _DIGITS.sub("0", raw.strip(EDGE).lower())
        if not found.isascii():
            found = found.encode("utf-8", "replace").decode()  # half a surrogate pair is no text
        _cores[raw] = found
    return found


def ending(text: str) -> tuple[str, str]:
    """How ``text`` ends: (kind, last token).

    Kinds: ``hanging`` a word of ``HANGING``, ``stop`` a sentence mark, ``closed`` a bracket, quotation or other symbol, ``open`` a mark that
    something must follow, ``word`` a bare word, ``marked`` a word followed by a sign of omission.
    """
    z = text.rstrip()
    bare = _MARK.sub("", z)
    marked = bare != z
    if not _WORDY.search(bare) or len(bare) == 1:
        return "closed", ""
    if _OPEN_END.search(bare):
        return ("marked" if marked else "open"), bare[-1]
    if _END.search(bare) or (_CLOSED_END.search(bare) and not marked):
        return ("stop" if _END.search(bare) else "closed"), ""
    if _LETTERS.search(bare[-40:]):
        return "closed", ""
    last = bare.split(None)[-1] if len(bare) < 400 else bare[-400:].split(None)[-1]
    token = core(last)
    if not token:
        return "closed", ""
    return ("marked" if marked else "hanging" if token in HANGING else "word"), token


def count_tokens(texts: Iterable[str]) -> dict[str, list[int]]:
    """Per token: [occurrences inside sentences, occurrences before a sentence mark]."""
    raw: Counter[str] = Counter()
    for text in texts:
        raw.update(text.split())
    out: dict[str, list[int]] = {}
    for word, n in raw.items():
        token = core(word)
        if token:
            out.setdefault(token, [0, 0])[1 if _END.search(word) else 0] += n
    return out


def token_table(counts: DataFrame, asked: DataFrame, alpha: float = 0.5, beta: float = 1.0, weight: float = 0.25, begun: float = 0.02) -> DataFrame:
    """Counts and the cut evidence of the tokens in ``asked`` (token; ends: unmarked ends of values of one sentence; unmarked: all).

    ``counts`` has token, inner, final (partial sums are added up here). The result has
    token, ends, cut_llr, and word_llr, which only weighs a cut inside the word (for values of one word,
    which may be any word). The end asked about is itself taken out of the counts.
    A token never seen to end a sentence gets ``alpha`` ends, or ``begun`` if longer words begin with it.
    An unmarked end counts as ``weight`` of a sentence end, since some of them are the cuts looked for.
    The first part of a hyphenated word is a word of its own and no beginning.
    Every token's beginnings are counted over the whole vocabulary, after aggregation, in a shuffle
    on the beginning; no token is dropped.
    """
    words = counts.groupBy("token").agg(F.sum("inner").alias("inner"), F.sum("final").alias("final"))
    totals = words.agg(
        F.coalesce(F.sum((F.col("inner") + F.col("final")) * (F.length("token") + 1)), F.lit(1)).alias("places"),
        F.coalesce(F.sum("final"), F.lit(0)).alias("finals"),
        F.coalesce(F.sum(F.col("inner") + F.col("final")), F.lit(0)).alias("words"),
    ).first()
    ends = asked.groupBy("token").agg(F.sum("ends").alias("ends"), F.sum("unmarked").alias("unmarked"))
    all_ends = ends.agg(F.coalesce(F.sum("ends"), F.lit(0)).alias("n")).first().n
    longer = words.where(F.length("token") > 1).select(
        F.explode(F.expr("transform(filter(sequence(1, length(token) - 1), i -> substring(token, i + 1, 1) <> '-'), i -> substring(token, 1, i))")).alias("token"),
        F.lit(0).alias("inner"), F.lit(0).alias("final"), (F.col("inner") + F.col("final")).alias("longer"),
    )
    table = (
        words.withColumn("longer", F.lit(0)).unionByName(longer)
        .groupBy("token").agg(*[F.sum(c).alias(c) for c in ("inner", "final", "longer")])
        .join(ends, "token", "right").na.fill(0, ["inner", "final", "longer"])
    )
    inside = F.greatest(F.col("inner") - F.col("unmarked"), F.lit(0)) + F.col("longer")
    cut = F.log((inside + beta) / F.lit(float(max(totals.places, 1))))

    least = F.when(F.col("longer") > 0, begun).otherwise(alpha)

    def done(own: int) -> Column:
        return F.log((F.col("final") + weight * F.greatest(F.col("ends") - own, F.lit(0)) + least) / F.lit(float(max(totals.finals + weight * all_ends, 1))))

    alone = F.log((F.col("longer") + beta) / F.lit(float(max(totals.places, 1)))) - F.log(
        (F.col("inner") + F.col("final") + F.greatest(F.col("ends") - 1, F.lit(0)) + alpha) / F.lit(float(max(totals.words + all_ends, 1)))
    )
    return table.select("token", "ends", (cut - done(1)).alias("cut_llr"), alone.alias("word_llr"))
