"""Noise of scanned pages in text: finding its kinds, and repairing the text into paragraphs.

Four kinds are looked for: words broken by a hyphen at a line end, misrecognised characters, running
heads, page numbers. Misrecognised words come from a generalised Levenshtein automaton run over tries of
the corpus vocabulary. The vocabulary and the words asked about are distinct words, aggregated over all
texts; they meet in shards by length and first (or last) characters, more of them the longer the word, so that no task
holds the whole vocabulary, and one confusion or edit anywhere in a word of three or more characters is always found (it
leaves one end as it is). Words of any number of confusions, at both ends too, have the same skeleton (each class of
characters taken for one another as one sign) and meet in a shard of that; words too long for a trie meet there only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, spread

# What optical recognition reads instead of what was printed (read, printed).
CONFUSIONS = (
    ("é", "e"), ("è", "e"), ("c", "e"), ("f", "t"), ("@", "a"), ("1", "i"), ("1", "l"), ("|", "i"), ("|", "l"), ("!", "i"), ("5", "s"), ("0", "o"),
    ("9", "g"), ("6", "b"), ("6", "é"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("$", "s"),
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("h", "li"), ("d", "cl"), ("m", "rn"),
    ("v", "y"), ("q", "g"), ("6", "ó"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("ii", "ü"), ("b", "ß"), ("ß", "b"), ("ci", "d"), ("ﬁ", "fi"), ("ﬂ", "fl"),
)
#: Units: a confusion costs 1, any other edit 2; a candidate may cost at most BOUND.
CONFUSED, EDITED, BOUND = 1, 2, 2
#: How many times more often the right word must occur than the wrong one, per confusion, and at least; a
#: word with a digit or symbol between letters needs a right word that occurs twice, and as often as it.
RATIO, LEAST = 6.0, 5
#: A word seen once, of so many characters, may be one confusion away from a right word that occurs so often.
LONG, FEW = 6, 3
#: Words of up to so many characters are looked up in tries; longer ones are compared with those of their skeleton.
TRIE_MAX = 40
# Conjunctions after a suspended hyphen.
SUSPENDED = ("and", "or", "to", "und", "oder", "bis", "sowie", "et", "ou", "y", "e", "o", "u", "ed")
#: Bits of the prefilter that is broadcast (fixed, 1 MB); what passes it is joined exactly.
FILTER_BITS = 1 << 23
HYPHENS = "-‐‑¬\xad"
_WORD = re.compile(r"[\w@|$]+(?:['’!][\w@|$]+)*")
_BREAK = re.compile(rf"[{HYPHENS}](?:[ \t]*\n[ \t]*| )(?=[^\W\d_])")
_RIGHT = re.compile(r"[\w@|]+")
_TERMINATED = re.compile(r"[.!?:;…][\"'»”’)\]]*$")
_ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_DIGIT = r"[0-9|lOo]{0,3}\d[0-9|lOo]{0,3}"
_PAGE = rf"(?:(?:page|pag|pág|página|seite|pagina|p|s|pg)\.?\s*\d+(?:\s*(?:/|of|von|de|sur|di|out of)\s*\d+)?|[-–—]\s*\d+\s*[-–—]|\[\s*\d+\s*\]|\(\s*\d+\s*\)|\d+\s*/\s*\d+|\d+)"
_PAGE_ONLY = re.compile(rf"^\s*(?:{_PAGE}|{_ROMAN})\s*$", re.I)
_BARE_NUMBER = re.compile(r"^\s*\d+\s*$")
_WITH_PAGE = re.compile(rf"^(?P<a>{_PAGE})(?:\s{{2,}}|\s*[|·•]\s*|\t)(?P<t>\S.*)$|^(?P<t2>\S.*?)(?:\s{{3,}}|\s*[|·•]\s+|\t)(?P<b>{_PAGE})$", re.I)
_HEADING_PAGE = re.compile(
    rf"(?:\s*\.{{3,}}\s*|\s*…+\s*|\s*[|·•]\s*|\s*\n\s*|\s{{2,}})(?:{_PAGE}|(?-i:{_ROMAN}))\s*$|^\s*(?:{_PAGE})(?:\s*\n\s*|\s{{2,}}|\s*[|·•]\s*)(?=\S)|\s[-–—]\s*\d+\s*[-–—]\s*$|\s(?:page|seite|página)\s+\d+(?:\s*(?:of|von|de|sur|/)\s*\d+)?\s*$|\s\[\d+\]\s*$", re.I)
_FOLD = str.maketrans({"0": "o", "1": "l", "|": "l", "i": "l", "5": "s", "@": "a", "9": "g", "6": "b", "8": "b", "c": "e", "é": "e", "è": "e", "f": "t", "h": "l"})
_CODE = re.compile(r"^(?:[a-z]?\d+[a-z]?\d*|[a-z]{1,3}\d+[a-z]*|v\d.*|\d+[a-z]+)$")


def _fold(line: str) -> str:
    """A line's text without numbers, case, marks, and the difference of characters taken for one another."""
    words = re.sub(r"[\W_]+", " ", re.sub(r"\b\d+\b", " ", line.lower())).strip()
    words = words.replace("ri", "n").replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w")
    return re.sub(r"ll", "l", words.translate(_FOLD))


def words_of(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if not w.isdigit()]


def _before(text: str, end: int) -> str:
    """The word that ends at ``end``, from its first letter on; empty if there is none."""
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_@|"):
        start -= 1
    while start < end and not text[start].isalpha():
        start += 1
    return text[start:end]


def breaks_of(text: str) -> list[tuple[int, int, str, str]]:
    """(end of the left part, start of the right part, left, right) at each hyphen before a line end or space."""
    out = []
    for m in _BREAK.finditer(text):
        left = _before(text, m.start())
        if left:
            out.append((m.start(), m.end(), left, _RIGHT.match(text, m.end())[0]))
    return out


def joined(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text without the words that a line-end hyphen parts, and (left, right, joined word) of each."""
    found = breaks_of(text)
    if not found:
        return text, []
    rest, at = [], 0
    for end, start, left, right in found:
        rest.append(text[at : max(at, end - len(left))])
        at = start + len(right)
    rest.append(text[at:])
    return " ".join(rest), [(left, right, (left + right).lower()) for _, _, left, right in found]


def parts(text: str, lines_found: list | None = None) -> tuple[str, str]:
    """(body, lines certain to be page furniture): hyphens are closed in the body only, across what stood between."""
    if "\n" not in text:
        return text, ""
    drop = {i for i, _, _, certain in (furniture(text) if lines_found is None else lines_found) if certain}
    if not drop:
        return text, ""
    lines = text.split("\n")
    return "\n".join(s for i, s in enumerate(lines) if i not in drop), "\n".join(s for i, s in enumerate(lines) if i in drop)


# ---- vocabulary and automaton ---------------------------------------------------------------------

def vocabulary(counts: DataFrame) -> DataFrame:
    """word, n (whole), joins (by closing a hyphen), over headings and texts of all chunks, from partial counts."""
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("joins").alias("joins"))


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _read, _printed in CONFUSIONS:
    _BY_FIRST.setdefault(_read[0], []).append((_read, _printed))


def candidates(word: str, trie: dict, bound: int = BOUND) -> list[tuple[str, int, bool]]:
    """(candidate, cost, only confusions) of all words in the trie within ``bound`` of ``word``.

    The automaton's states are (position in the word, cost, whether a plain edit was made); each trie
    node carries its set of states, and a branch ends where the set is empty. A confusion may read one or
    two characters of the word for one or two of the trie.
    """
    size, found = len(word), []
    stack = [(trie, "", {(0, False): 0})]
    while stack:
        node, path, states = stack.pop()
        # leaving out characters of the word
        todo = list(states.items())
        while todo:
            (i, plain), cost = todo.pop()
            if i < size and cost + EDITED <= bound and states.get((i + 1, True), bound + 1) > cost + EDITED:
                states[(i + 1, True)] = cost + EDITED
                todo.append(((i + 1, True), cost + EDITED))
        if "" in node:
            ends = [(cost, plain) for (i, plain), cost in states.items() if i == size]
            if ends and path != word:
                cost, plain = min(ends)
                found.append((path, cost, not plain))
        for char, child in node.items():
            if not char:
                continue
            after: dict[tuple[int, bool], int] = {}
            jumps: dict[str, dict[tuple[int, bool], int]] = {}

            def put(where: dict, key: tuple[int, bool], cost: int) -> None:
                if where.get(key, bound + 1) > cost:
                    where[key] = cost

            for (i, plain), cost in states.items():
                if i < size:
                    if word[i] == char:
                        put(after, (i + 1, plain), cost)
                    if cost + CONFUSED <= bound:
                        for read, printed in _BY_FIRST.get(word[i], ()):
                            if printed[0] == char and word.startswith(read, i):
                                target = after if len(printed) == 1 else jumps.setdefault(printed[1:], {})
                                put(target, (i + len(read), plain), cost + CONFUSED)
                    if cost + EDITED <= bound:
                        put(after, (i + 1, True), cost + EDITED)
                if cost + EDITED <= bound:
                    put(after, (i, True), cost + EDITED)
            if after:
                stack.append((child, path + char, after))
            for rest, at in jumps.items():
                step = child
                for c in rest:
                    step = step.get(c)
                    if step is None:
                        break
                else:
                    stack.append((step, path + char + rest, at))
    best: dict[str, tuple[int, bool]] = {}
    for path, cost, confused in found:
        old = best.get(path)
        if old is None or (cost, not confused) < (old[0], not old[1]):
            best[path] = (cost, confused)
    return [(p, c, k) for p, (c, k) in best.items()]


def reads(wrong: str, right: str, bound: int = BOUND) -> int | None:
    """The least cost at which confusions alone read ``right`` as ``wrong``, or None beyond ``bound``; linear in the words' length."""
    best, stack = None, [(0, 0, 0)]
    while stack:
        i, j, cost = stack.pop()
        step = 64
        while step:  # over what is alike, in strides
            if wrong[i : i + step] == right[j : j + step] and i + step <= len(wrong) and j + step <= len(right):
                i, j = i + step, j + step
            else:
                step //= 2
        if i == len(wrong) and j == len(right):
            best = cost if best is None else min(best, cost)
            continue
        if cost + CONFUSED > bound or i == len(wrong) or j == len(right):
            continue
        # A confusion may also begin before the first difference ("rn" against "rm").
        for back in (0, 1):
            k, n = i - back, j - back
            if min(k, n) >= 0:
                for read, printed in _BY_FIRST.get(wrong[k], ()):
                    if wrong.startswith(read, k) and right.startswith(printed, n):
                        stack.append((k + len(read), n + len(printed), cost + CONFUSED))
    return best


# Characters as the strokes that the confusions of two for one take them for.
_SPELLED = {"m": "rri", "n": "ri", "u": "ii", "ü": "ii", "d": "cl", "h": "li", "w": "vv", "ﬁ": "fi", "ﬂ": "fl"}


def _classes() -> dict[str, str]:
    """Each character's sign: one for all that single characters of ``CONFUSIONS`` can be taken for, over any number of steps."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for pair in CONFUSIONS:
        one, other = ("".join(_SPELLED.get(c, c) for c in side) for side in pair)
        if len(one) == len(other):
            for x, y in zip(one, other):
                root[find(x)] = find(y)
    return {c: find(c) for pair in CONFUSIONS for side in pair for x in side for c in _SPELLED.get(x, x)}


_SIGNS = _classes()
_SKELETON = str.maketrans({c: "".join(_SIGNS.get(x, x) for x in _SPELLED.get(c, c)) for c in {*_SPELLED, *_SIGNS}})


def skeleton(word: str) -> str:
    """The word with one sign for all characters taken for one another: any confusions leave it as it is."""
    return word.translate(_SKELETON)


_FOUND = pa.schema([("wrong", pa.string()), ("n", pa.int64()), ("right", pa.string()), ("right_n", pa.int64()), ("cost", pa.int32()), ("confused", pa.bool_())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by shard, in each the vocabulary first: a trie per shard, then its queries."""
    shard, trie, counts, most = None, {}, {}, 0
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _FOUND}
        for key, asked, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key != shard:
                shard, trie, counts, most = key, {}, {}, 0
            if not asked:
                if len(word) <= TRIE_MAX:
                    node = trie
                    for ch in word:
                        node = node.setdefault(ch, {})
                    node[""] = True
                counts[word] = n
                most = max(most, n)
            elif counts and (RATIO * n <= most or not word.isalpha() or (n <= 1 and most >= FEW and len(word) >= LONG)):
                # No other word can stand the tests of misread().
                hits = candidates(word, trie) if trie else []
                if key[0] == "s":  # longer words, of its own skeleton only
                    costs = ((right, reads(word, right)) for right in counts if right != word and max(len(right), len(word)) > TRIE_MAX)
                    hits = [h for h in hits if len(word) <= TRIE_MAX] + [(right, cost, True) for right, cost in costs if cost]
                for right, cost, confused in hits:
                    for name, x in zip(out, (word, n, right, counts[right], cost, confused)):
                        out[name].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=_FOUND)


_SHARDS = pa.schema([("shard", pa.string()), ("asked", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])


def _ends(word: str, length: int) -> tuple[str, str]:
    """The shards of words of ``length`` that begin, or end, like ``word``: by one character, by two from 6, by three from 10 characters on.

    One confusion or edit lies within four characters, so that it cannot touch both ends so taken.
    """
    k = 1 if length < 6 else 2 if length < 10 else 3
    return f"a{length} {word[:k]}", f"z{length} {word[-k:]}"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word once per shard that it belongs to, or, if asked, that may hold its right word."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _SHARDS}
        for word, n, asked in zip(*(c.to_pylist() for c in batch.columns)):
            size = len(word)
            keys = {"s" + hashlib.blake2b(skeleton(word).encode("utf-8", "replace"), digest_size=12).hexdigest()}
            for length in range(size - BOUND, size + BOUND + 1) if asked else (size,):
                if 0 < length <= TRIE_MAX:
                    keys.update(_ends(word, length))
            for key in keys:
                for name, x in zip(out, (key, asked, word, n)):
                    out[name].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=_SHARDS)


def misread(vocab: DataFrame) -> DataFrame:
    """wrong, right, score: the words that are misreadings, with every right word that stands the test.

    A right word occurs at least ``LEAST`` times, and ``RATIO`` times as often as the wrong one for
    each confusion between them (less where a digit or symbol stands in the word, or where a long word occurs once). A word that only a plain edit separates from a frequent one (a name,
    an inflection) is none. Codes ("pH7", "a1b") are none unless reading them makes a frequent word.
    """
    has_letter = F.col("word").rlike(r"\p{L}")
    usable = vocab.where(has_letter & (F.length("word") >= 2) & ~F.col("word").contains("-"))
    known = usable.where((F.col("n") >= 2) & ~F.col("word").rlike(r"[0-9@|$]")).select("word", "n", F.lit(False).alias("asked"))
    likely = "[" + "".join(re.escape(c) for c in sorted({r[0] for r, _ in CONFUSIONS})) + "]"
    asked = usable.where(F.col("word").rlike(likely)).select("word", F.greatest("n", F.least("joins", F.lit(1))).alias("n"), F.lit(True).alias("asked"))
    # By number, so that it stays: the shards are small in bytes, but searching them is work.
    tasks = max(8, int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = known.unionByName(asked).mapInArrow(_shards, "shard string, asked boolean, word string, n long")
    hits = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "asked").mapInArrow(_search, "wrong string, n long, right string, right_n long, cost int, confused boolean")
    score = F.log("right_n") - F.log(F.col("n") + 1.0) - F.col("cost") * F.log(F.lit(RATIO))
    often = (F.col("right_n") >= LEAST) & (F.col("right_n") >= F.col("n") * F.pow(F.lit(RATIO), F.col("cost")))
    often = often | ((F.col("right_n") >= FEW) & (F.col("n") <= 1) & (F.col("cost") == CONFUSED) & (F.length("wrong") >= LONG))
    marked = F.col("wrong").rlike(r"\p{L}.*[0-9@|$!]|[0-9@|$!].*\p{L}.*\p{L}") & (F.col("right_n") >= F.col("n")) & (F.length("wrong") >= 3)
    good = hits.where(F.col("confused") & (often | marked))
    return good.select("wrong", "right", score.alias("score")).dropDuplicates(["wrong", "right"])


# ---- one chunk ------------------------------------------------------------------------------------


def heading_page(heading: str) -> bool:
    """Whether a page number stands at an edge of the heading, set apart from its words."""
    return bool(_HEADING_PAGE.search(heading)) and bool(re.search(r"[^\W\d_]{3,}", heading))


def furniture(text: str) -> list[tuple[int, str, str, bool]]:
    """(line, kind, key, certain) of the lines that may be page furniture.

    ``number`` lines hold a page number alone; ``both`` lines a head and a number set apart; ``hard`` lines are
    heads in capitals or of several parts; ``head`` lines are short lines that may be heads: certain, as far as one chunk can
    tell, where they interrupt a sentence without being a full wrapped line. Their key has the last word, by
    what it does elsewhere in the corpus.
    """
    lines = text.split("\n")
    if len(lines) < 2:
        return []
    bare = [s.strip() for s in lines]
    lengths = sorted(len(s) for s in bare if s)
    typical = lengths[int(len(lengths) * 0.6)] if lengths else 0
    out: list[tuple[int, str, str, bool]] = []
    follows: list[str | None] = [None] * len(bare)  # the next line that is not blank
    for i in range(len(bare) - 2, -1, -1):
        follows[i] = bare[i + 1] or follows[i + 1]
    before, last = None, None  # the last line before that is neither blank nor surely furniture
    for i, s in enumerate(bare):
        if not s:
            continue
        before, last, after = last or before, s, follows[i]
        ends = s[0] + s[-1]
        numbered = any(c.isdigit() for c in ends) or ends[1] in ")]-–—"
        if (numbered or len(s) <= 8) and _PAGE_ONLY.match(s):
            if _BARE_NUMBER.match(s) and ((before or "").endswith((":", "=")) or "\t" in lines[i - 1 if i else 0]):
                continue
            if re.fullmatch(_ROMAN, s, re.I) and not (s.islower() and (before is None or not before.endswith(":"))):
                continue
            out.append((i, "number", "", True))
            last = None
            continue
        if "\t" in s or s.endswith((".", ",", ";", ":", "!", "?")):
            continue
        m = _WITH_PAGE.match(s) if numbered or s[0] in "[(-–—PpSs" else None
        if m and re.search(r"[^\W\d_]{2,}", m["t"] or m["t2"]) and not re.search(r"\.{3,}", s):
            out.append((i, "both", _fold(m["t"] or m["t2"]), True))
            last = None
            continue
        lower = sum(map(str.islower, s))
        upper = sum(map(str.isupper, s)) if lower <= 0.1 * len(s) else 0  # fewer capitals than nine in ten letters do not matter
        capitals = upper + lower >= 4 and upper >= 0.9 * (upper + lower)
        sides = [p for p in re.split(r"\s[·•|]\s", s) if re.search(r"[^\W\d_]{2,}", p)] if "·" in s or "•" in s or "|" in s else []
        full = after is not None and len(s) + 1 + len(after.split(None, 1)[0]) > typical - 3
        ended = before is None or bool(_TERMINATED.search(before))
        interrupts = (
            not ended and after is not None and not full and (s[0].isupper() or s[0].isdigit() or not s[0].isalnum()) and (after[0].islower() or before[-1] in HYPHENS)
            and (len(s) <= 0.7 * typical or all(w[:1].isupper() for w in s.split() if len(w) > 3)) and not re.search(r"[.!?]\s", s)
        )
        certain = interrupts or capitals or len(sides) >= 2
        if certain or ((ended or after is None or not full) and len(s.split()) <= 9):
            key = _fold(s)
            if len(key) < 3:
                continue
            out.append((i, "hard" if capitals or len(sides) >= 2 else "head", key, certain))
            if certain:
                last = None
    return out


_ROWS = pa.schema([
    ("row", pa.string()), ("chunk_id", pa.string()), ("field", pa.string()), ("fact", pa.string()), ("a", pa.string()), ("b", pa.string()),
    ("certain", pa.bool_()), ("words", pa.list_(pa.string())), ("n", pa.int64()), ("joins", pa.int64()),
])
ROWS = "row string, chunk_id string, field string, fact string, a string, b string, certain boolean, words array<string>, n long, joins long"
_FACTS = pa.schema([(f, _ROWS.field(f).type) for f in ("chunk_id", "field", "fact", "a", "b", "certain")])
FACTS = "chunk_id string, field string, fact string, a string, b string, certain boolean"
_LISTED = re.compile(r"(?:[-*•]|\d+[.)]|[a-z][.)])\s")
_INNER_HYPHEN = re.compile(r"(?<![^\W\d_])[^\W\d_]+-[^\W\d_]+")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Everything that one chunk tells: its furniture, hyphens and distinct words, and per batch the word counts.

    A word counts as whole where it stands so, and as joined where it comes of closing a hyphen; hyphenated words inside
    a line are counted too, as the evidence that a hyphen belongs to the wording.
    """
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _ROWS}
        whole: Counter[str] = Counter()
        closed: Counter[str] = Counter()

        def put(row, chunk=None, field=None, fact=None, a=None, b=None, certain=None, words=None, n=None, joins=None) -> None:
            for name, x in zip(out, (row, chunk, field, fact, a, b, certain, words, n, joins)):
                out[name].append(x)

        for chunk, heading, text in zip(*(c.to_pylist() for c in batch.columns)):
            for field, value in (("heading", heading), ("text", text)):
                if not value:
                    continue
                lines_found = furniture(value) if field == "text" else []
                if field == "heading" and heading_page(value):
                    put("fact", chunk, field, "page_number", certain=True)
                for _, kind, key, certain in lines_found:
                    if kind in ("number", "both"):
                        put("fact", chunk, field, "page_number", certain=True)
                    if kind != "number":
                        put("fact", chunk, field, "head", key, "soft" if kind == "head" else "hard", certain)
                body, furnished = parts(value, lines_found)
                rest, pairs = joined(body)
                low = rest.lower()
                words = _WORD.findall(low)
                if furnished:
                    words += _WORD.findall(furnished.lower())
                whole.update(words)
                if "-" in low:
                    whole.update(_INNER_HYPHEN.findall(low))
                joins = [p[2] for p in pairs]
                closed.update(joins)
                for left, right, _ in set(pairs):
                    put("fact", chunk, field, "hyphen", left, right)
                put("words", chunk, field, words=[w for w in {*words, *joins} if not w.isdigit()])
        for word in {*whole, *closed}:
            if not word.isdigit():
                put("count", a=word, n=whole[word], joins=closed[word])
        yield pa.RecordBatch.from_pydict(out, schema=_ROWS)


def _bit(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % FILTER_BITS


def _pick(bits_ref):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each chunk that the filter lets through; each distinct word of a batch is looked up once."""
        bits = bits_ref.value
        for batch in batches:
            lists = batch.column("words")
            coded = lists.flatten().dictionary_encode()
            passes = np.array([bits[at >> 3] >> (at & 7) & 1 for at in map(_bit, coded.dictionary.to_pylist())], dtype=bool)
            kept = np.flatnonzero(passes[coded.indices.to_numpy(zero_copy_only=False)]) if len(coded) else np.array([], dtype=np.int64)
            of = pc.list_parent_indices(lists).take(pa.array(kept))
            n = len(kept)
            yield pa.RecordBatch.from_arrays([
                batch.column("chunk_id").take(of), batch.column("field").take(of), pa.array(["word"] * n, pa.string()),
                coded.dictionary.take(coded.indices.take(pa.array(kept))).cast(pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()),
            ], schema=_FACTS)

    return pick


def _filter(words: DataFrame, column: str = "wrong") -> bytes:
    """A bit per hashed word: at most FILTER_BITS/8 rows reach the driver."""
    at = words.select((F.crc32(F.encode(column, "UTF-8")) % FILTER_BITS).alias("at"))
    cells = at.select(F.expr("cast(at div 8 as int)").alias("cell"), F.expr("shiftleft(1, cast(at % 8 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("value"))
    bits = bytearray(FILTER_BITS // 8)
    for r in cells.toLocalIterator():
        bits[r.cell] = r.value
    return bytes(bits)


def _hyphens(facts: DataFrame, vocab: DataFrame, wrong: DataFrame) -> DataFrame:
    """chunk_id, field, a, b of the hyphens that break a word.

    The closed word against the hyphenated one: the more frequent wins. Where neither occurs, a hyphen
    before a capital or a conjunction ("pre- and"), or between two words that are each well known, belongs to the
    wording.
    """
    pairs = facts.where("fact = 'hyphen'").select("a", "b").dropDuplicates()
    forms = pairs.select("a", "b", F.explode(F.array(
        F.struct(F.lit("closed").alias("form"), F.lower(F.concat("a", "b")).alias("word")),
        F.struct(F.lit("hyphenated").alias("form"), F.lower(F.concat("a", F.lit("-"), "b")).alias("word")),
        F.struct(F.lit("left").alias("form"), F.lower("a").alias("word")),
        F.struct(F.lit("right").alias("form"), F.lower("b").alias("word")),
    )).alias("f")).select("a", "b", "f.*")
    known = forms.join(vocab.select("word", "n"), "word", "left").join(wrong.select(F.col("wrong").alias("word"), F.lit(1).alias("bad")).dropDuplicates(), "word", "left")
    n = lambda form: F.coalesce(F.max(F.when(F.col("form") == form, F.col("n"))), F.lit(0))
    counted = known.groupBy("a", "b").agg(*[n(f).alias(f) for f in ("closed", "hyphenated", "left", "right")], F.max(F.when(F.col("form") == "closed", F.col("bad"))).alias("bad"))
    capital = F.substring("b", 1, 1).rlike(r"\p{Lu}") & ~F.col("a").rlike(r"^\p{Lu}+$")
    suspended = F.lower("b").isin(*SUSPENDED)
    apart = suspended | (F.col("left") >= LEAST) & (F.col("right") >= LEAST)
    breaks = (
        F.when((F.col("hyphenated") > 0) & (F.col("hyphenated") >= F.col("closed")), False)
        .when((F.col("closed") > 0) | F.col("bad").isNotNull(), True)
        .when(capital | apart, False)
        .otherwise(True)
    )
    broken = counted.where(breaks).select("a", "b")
    return facts.where("fact = 'hyphen'").join(broken, ["a", "b"])


def _heads(facts: DataFrame) -> DataFrame:
    """chunk_id, field, a of running heads.

    Hard lines are heads. A line that interrupts a sentence is one if the same line, or lines that begin with the same word,
    do so elsewhere, and more often than not; any line is one if its key is a head often enough elsewhere.
    """
    first = F.split("a", " ")[0]
    lines = facts.where("fact = 'head'").withColumn("first", first)
    counts = [F.count("*").alias("n"), F.count_if("certain").alias("sure"), F.count_if(F.col("b") == "hard").alias("hard")]
    keys = lines.groupBy("a").agg(*counts)
    firsts = lines.groupBy("first").agg(*counts).where((F.col("sure") >= 2) & (F.col("sure") >= 0.5 * F.col("n"))).select("first", F.lit(True).alias("opens_heads"))
    known = keys.withColumn("first", first).join(firsts, "first", "left").where(
        (F.col("hard") > 0) | ((F.col("sure") >= 1) & F.coalesce("opens_heads", F.lit(False))) | ((F.col("sure") >= 2) & (F.col("sure") >= 0.15 * F.col("n")))
    ).select("a")
    return lines.join(known, "a", "left_semi").select("chunk_id", "field", "a")


def inspect(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, vocabulary, misread words), each written once to the shared folder."""
    one = spread(chunks.select(F.col("id").cast("string").alias("chunk_id"), F.col("heading").cast("string"), F.col("text").cast("string")))
    rows = cut(one.mapInArrow(_read, ROWS))
    vocab = cut(vocabulary(rows.where("row = 'count'").select(F.col("a").alias("word"), "n", "joins")))
    wrong = cut(misread(vocab))
    bits = chunks.sparkSession.sparkContext.broadcast(_filter(wrong))
    hits = cut(rows.where("row = 'words'").select("chunk_id", "field", "words").mapInArrow(_pick(bits), FACTS))
    facts = rows.where("row = 'fact'").select("chunk_id", "field", "fact", "a", "b", "certain").unionByName(hits)
    return facts, vocab, wrong


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, field_name, noise_kind), one row per chunk, field and kind.

    Null and blank fields, single-line texts (for furniture) and empty tables give no rows; redelivered
    chunks count once. A head line that carries a number counts for both kinds.
    """
    facts, vocab, wrong = inspect(chunks)
    words = facts.where("fact = 'word'").join(wrong.select(F.col("wrong").alias("a")).dropDuplicates(), "a", "left_semi")
    parts = [
        _hyphens(facts, vocab, wrong).select("chunk_id", "field", F.lit("hyphen_break").alias("kind")),
        words.select("chunk_id", "field", F.lit("char_error").alias("kind")),
        _heads(facts).select("chunk_id", "field", F.lit("running_head").alias("kind")),
        facts.where("fact = 'page_number'").select("chunk_id", "field", F.lit("page_number").alias("kind")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.dropDuplicates().select("chunk_id", F.col("field").alias("field_name"), F.col("kind").alias("noise_kind"))


# ---- repair ---------------------------------------------------------------------------------------


_CONTEXT = pa.schema([("chunk_id", pa.string()), ("before", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _contexts(wrong_ref, right_ref):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With chunk_id, the word before each word of that chunk that may be misread in several ways; without, counts of what stands before its right words."""
        wrongs, rights, seen = wrong_ref.value, right_ref.value, {}
        for batch in batches:
            asks: set[tuple[str, str, str]] = set()
            counts: Counter[tuple[str, str]] = Counter()
            for chunk, heading, text in zip(*(c.to_pylist() for c in batch.columns)):
                for value in (heading, text):
                    if not value:
                        continue
                    before = ""
                    for word in words_of(joined(value)[0]):
                        hit = seen.get(word)
                        if hit is None:
                            if len(seen) > 500_000:
                                seen.clear()
                            at = _bit(word)
                            hit = seen[word] = (wrongs[at >> 3] >> (at & 7) & 1, rights[at >> 3] >> (at & 7) & 1)
                        if before:
                            if hit[0]:
                                asks.add((chunk, before, word))
                            if hit[1]:
                                counts[(before, word)] += 1
                        before = word
            yield pa.RecordBatch.from_pydict({
                "chunk_id": [a[0] for a in asks] + [None] * len(counts), "before": [a[1] for a in asks] + [c[0] for c in counts],
                "word": [a[2] for a in asks] + [c[1] for c in counts], "n": [None] * len(asks) + list(counts.values()),
            }, schema=_CONTEXT)

    return contexts


def _same_case(word: str, right: str) -> str:
    if word.isupper() and len(word) > 1:
        return right.upper()
    if word[:1].isupper() or (not word[:1].isalpha() and word[1:2].isupper()):
        return right[:1].upper() + right[1:]
    return right


def close(text: str, breaks: set[tuple[str, str]]) -> str:
    """The text with the broken words among ``breaks`` closed; other hyphens stay."""
    out, at = [], 0
    for end, start, left, right in breaks_of(text):
        if (left, right) in breaks:
            out.append(text[at:end])
            at = start
    return "".join([*out, text[at:]])


def repair_text(text: str, fixes: dict[str, str], by_context: dict[tuple[str, str], str], breaks: set[tuple[str, str]], heads: set[str]) -> str:
    """Remove furniture lines, close broken words, put right the misread ones, and reflow wrapped lines."""
    lines = text.split("\n")
    drop = {i for i, kind, key, certain in furniture(text) if kind != "head" or key in heads}
    kept = [s for i, s in enumerate(lines) if i not in drop]
    body = "\n".join(kept)

    body = close(body, breaks) if breaks else body
    body = re.sub(r"([^\W\d_]-)[ \t]*\n[ \t]*(?=[^\W\d_])", r"\1", body) if "-" in body and "\n" in body else body
    if fixes or by_context:
        previous = ""
        out, at = [], 0
        for m in _WORD.finditer(body):
            w = m[0].lower()
            found = fixes.get(w) and (by_context.get((previous, w)) or fixes[w])
            if found:
                out += (body[at : m.start()], _same_case(m[0], found))
                at = m.end()
            previous = found or w
        body = "".join([*out, body[at:]])
    paragraphs, current = [], []
    width = sorted(len(s) for s in kept if s.strip())
    typical = width[int(len(width) * 0.6)] if width else 0
    for line in body.split("\n"):
        s = line.strip()
        if not s or "\t" in line or _LISTED.match(s):
            if current:
                paragraphs.append(" ".join(current))
                current = []
            if s:
                paragraphs.append(line.rstrip())
            continue
        current.append(s)
        if (_TERMINATED.search(s) and len(s) < typical - 12) or s.endswith(":"):
            paragraphs.append(" ".join(current))
            current = []
    if current:
        paragraphs.append(" ".join(current))
    return "\n\n".join(paragraphs)


def repair_heading(heading: str, fixes: dict[str, str], breaks: set[tuple[str, str]]) -> str:
    bare = _HEADING_PAGE.sub("", heading)
    closed = close(bare, breaks)
    return re.sub(r"\s*\n\s*", " ", _WORD.sub(lambda m: _same_case(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], closed)).strip()


_REPAIRED = pa.schema([("chunk_id", pa.string()), ("heading", pa.string()), ("text", pa.string())])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _REPAIRED}
        for chunk, heading, text, fixes, context, breaks, heads in zip(*(c.to_pylist() for c in batch.columns)):
            fix = {r["wrong"]: r["right"] for r in fixes or []}
            ctx = {(r["before"], r["wrong"]): r["right"] for r in context or []}
            broken = {(r["a"], r["b"]) for r in breaks or []}
            out["chunk_id"].append(chunk)
            out["heading"].append(repair_heading(heading, fix, broken) if heading else heading)
            out["text"].append(repair_text(text, fix, ctx, broken, set(heads or [])) if text else text)
        yield pa.RecordBatch.from_pydict(out, schema=_REPAIRED)


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, heading, text) of all chunks, repaired; a chunk without noise only has its lines reflowed.

    Of several right words for a misread one, the one that most often follows the word before it is
    taken, then the more frequent one. Null stays null, blank stays blank; copies count once.
    """
    facts, vocab, wrong = inspect(chunks)
    one = chunks.select(F.col("id").cast("string").alias("chunk_id"), F.col("heading").cast("string"), F.col("text").cast("string")).dropDuplicates(["chunk_id"])
    many = wrong.groupBy("wrong").agg(F.count("*").alias("n")).where("n > 1").select("wrong")
    rivals = cut(wrong.join(many, "wrong", "left_semi"))
    sc = chunks.sparkSession.sparkContext
    filters = sc.broadcast(_filter(rivals, "wrong")), sc.broadcast(_filter(rivals, "right"))
    around = cut(one.mapInArrow(_contexts(*filters), "chunk_id string, before string, word string, n long"))
    asks = around.where("chunk_id is not null").select("chunk_id", "before", F.col("word").alias("wrong")).dropDuplicates()
    counts = around.where("chunk_id is null").groupBy("before", F.col("word").alias("right")).agg(F.sum("n").alias("n"))
    ranked = asks.select("before", "wrong").dropDuplicates().join(rivals, "wrong").join(counts, ["before", "right"], "left").groupBy("before", "wrong").agg(
        F.max_by("right", F.struct(F.coalesce("n", F.lit(0)), "score", "right")).alias("right")
    )
    best = wrong.groupBy("wrong").agg(F.max_by("right", F.struct("score", "right")).alias("right"))
    words = facts.where("fact = 'word'").select("chunk_id", F.col("a").alias("wrong"))
    fixes = words.join(best, "wrong").groupBy("chunk_id").agg(F.collect_set(F.struct("wrong", "right")).alias("fixes"))
    context = asks.join(ranked, ["before", "wrong"]).groupBy("chunk_id").agg(F.collect_set(F.struct("before", "wrong", "right")).alias("context"))
    breaks = _hyphens(facts, vocab, wrong).groupBy("chunk_id").agg(F.collect_set(F.struct("a", "b")).alias("breaks"))
    heads = _heads(facts).groupBy("chunk_id").agg(F.collect_set("a").alias("heads"))
    rows = one
    for extra in (fixes, context, breaks, heads):
        rows = rows.join(extra, "chunk_id", "left")
    return rows.select("chunk_id", "heading", "text", "fixes", "context", "breaks", "heads").mapInArrow(_repair, "chunk_id string, heading string, text string")
