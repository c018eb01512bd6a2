"""Language of short texts: scripts, function words, and a word model fitted on the corpus itself.

Texts whose function words clearly name a language train counts of hashed words; the model has
``BUCKETS`` cells for each of the ``LANGS``, whatever the corpus, so it may be collected and broadcast
(at most 4 MB). With it also answers of two or three words can be told apart.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

BUCKETS = 1 << 15
LANGS = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "cs", "sv", "da", "fi", "hu", "ro", "tr")
# Common function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to is in that it for with as which are this be on by what from not an or when why how has only",
    "de": "der die das und ist nicht ein eine den von zu mit sich auf dem des wenn im wird sie welche wie durch nur als dass",
    "fr": "le la les de des du et est une un que qui dans pour elle il ne pas par sur au avec ce quand quelle plus aux",
    "es": "el la los las de del y es una un que en se por con para no su lo al cuando como esta qué cuál solo más",
    "it": "il lo gli di del della che e è una un per con non si da nel sono come quando quale più anche solo questa delle dei degli alla alle nella nessuna nessun due perché viene vengono dopo così poi essere stato entrambi",
    "pt": "o a os as do da dos das e é uma um que em não se por com para no na quando como mais qual só isso não pois já tinha trata porque depois esta este pelo pela nos nas são está ambas mesmo",
    "pl": "jest nie się że na do jak przez ale który która które tym tego oraz gdy czy dla od są był była może tylko także ze wszystko więc przy jego po jako między każdy",
    "cs": "je že se není jsou na který která které jako ale nebo pro při podle také jen když byl byla může mezi všechny více protože tak kde co aby před jeho této tento každý ze",
    "sv": "och att det som är inte på för av till med den ett om har kan från eller men när vid också bara vilken varför hur mellan alla mer denna detta blir genom efter därför",
    "da": "og at det som er ikke på for af til med den et om har kan fra eller men når ved også kun hvilken hvorfor hvordan mellem alle mere denne dette bliver gennem efter derfor",
    "fi": "ja on ei että se joka kun kuin myös tai mutta ovat vain jos niin sen sekä mikä miksi miten koska kaikki voi oli joita tämä siitä välillä ennen jälkeen",
    "hu": "és az hogy nem egy is van ez csak de vagy meg volt mint amely amelyek azért mert kell minden között szerint után alatt lehet ha ezt annak hogyan miért",
    "ro": "și este nu care pentru că din mai sunt cu sau dar când prin între după toate fost această acest numai dacă fi unei unui astfel deoarece cum cele lui",
    "tr": "ve bir bu için ile olarak değil çok daha gibi ama veya olan kadar sonra ne nasıl neden arasında her ancak sadece çünkü ise hem olduğunu olur tarafından",
    "nl": "de het een en van is dat niet op te met voor zijn aan er als door welke wat wanneer hoe maar ook alleen deze wordt worden omdat na naar bij geen twee dan dit heeft onder tussen beide",
}
_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_KNOWN_IN = {w: [i for i, lang in enumerate(LANGS) if w in _SETS[lang]] for s in _SETS.values() for w in s}
_FLOOR, _USUAL = math.log(1e-6), math.log(3e-3)
_NOTHING = (0.0,) * len(LANGS)
_BEYOND_LATIN = re.compile(r"[\u0250-\u1dff\u2c00-\U0010ffff]")
_WORD = re.compile(r"[^\W\d_]+")
_buckets: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bucket(word: str) -> int:
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) > 500_000:
            _buckets.clear()
        found = _buckets[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
    return found


def by_function_words(words: Iterable[str]) -> str | None:
    """The language that has at least two more function words here than any other, if any."""
    distinct = set(words)
    ranked = sorted(((len(distinct & s), lang) for lang, s in _SETS.items()), reverse=True)
    return ranked[0][1] if ranked[0][0] >= ranked[1][0] + 2 else None


def count_languages(texts: Iterable[str]) -> Counter:
    """Counts of (language, bucket) over the texts whose language is plain."""
    by_lang: dict[str, Counter] = {}
    for text in texts:
        words = words_of(text)
        lang = by_function_words(words)
        if lang:
            by_lang.setdefault(lang, Counter()).update(words)
    out: Counter = Counter()
    for lang, counts in by_lang.items():
        for word, n in counts.items():
            out[(lang, bucket(word))] += n
    return out


def log_model(counts: dict[tuple[str, int], int]) -> dict[int, tuple[float, ...]]:
    """bucket -> log relative frequency per language; the same small value for what a language lacks."""
    totals = Counter()
    for (lang, _), n in counts.items():
        totals[lang] += n
    model: dict[int, list[float]] = {}
    for (lang, b), n in counts.items():
        row = model.setdefault(b, [_FLOOR] * len(LANGS))
        if totals[lang] >= 200:
            row[LANGS.index(lang)] = math.log(n / totals[lang] + 1e-6)
    return {b: tuple(row) for b, row in model.items()}


def word_scores(word: str, model: dict[int, tuple[float, ...]]) -> tuple[float, ...]:
    """Log score of a word per language; zeros for a word that nothing is known of.

    A function word that the corpus hardly has still speaks for its languages.
    """
    row, known = model.get(bucket(word)), _KNOWN_IN.get(word)
    if known is None:
        return row or _NOTHING
    base = row or (_FLOOR,) * len(LANGS)
    return tuple(max(x, _USUAL) if i in known else x for i, x in enumerate(base))


def scores(words: Iterable[str], model: dict[int, tuple[float, ...]], cache: dict[str, tuple[float, ...]] | None = None) -> list[float]:
    """Log score per language over the distinct words; ``cache`` keeps the words' scores for one model."""
    cache = {} if cache is None else cache
    rows = []
    for w in set(words):
        row = cache.get(w)
        if row is None:
            if len(cache) > 500_000:
                cache.clear()
            row = cache[w] = word_scores(w, model)
        rows.append(row)
    return [sum(column) for column in zip(*rows)] if rows else list(_NOTHING)


def foreign_script(text: str) -> float:
    """Share of the letters that are not Latin."""
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return 0.0
    letters = [c for c in text if c.isalpha()]
    return sum(1 for c in letters if ord(c) > 0x24F) / len(letters) if letters else 0.0
