"""Defects of question-answer pairs: refusals, empty, truncated, copied and foreign answers.

Refusal grammars, a pushdown parser for what is left open, greedy string tiling of answer against question,
script and language checks, and ending evidence (``endings``) each look at one pair in one pass; the only
shuffles are of narrow rows: token counts, ending tokens, refused replies, and one row per item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import endings, language, pushdown
from folioflow.session import cut, spread

# Grammars of declining, by language; they apply at the start of a sentence.
_EN = r"(?:i['’]?m sorry|i am sorry|sorry|my apologies|i apologi[sz]e|unfortunately|regrettably|as an? (?:ai|language)[\w -]*|i regret)?[\s,.;:—–-]*(?:but\s+)?(?:i|we)(?:['’]m| am|['’]re| are)?\s*(?:can ?not|can['’]?t|could not|unable|not able|won['’]?t|will not|must decline|have to decline|decline|do not feel|don['’]t feel|not comfortable|would rather not|['’]d rather not|refuse|must refuse|am not allowed)\b"
_DE = r"(?:es tut mir (?:sehr )?leid|leider|entschuldigung|bedauerlicherweise|tut mir leid)[\s,.;:—–-]*(?:aber\s+)?(?:ich\b|wir\b|kann ich|darf ich|ist es mir|muss ich)|(?:ich|wir) (?:kann|kannst|können|darf|dürfen|möchte|werde)\b[^.!?]{0,80}\b(?:nicht|keine|nichts)\b|ich (?:muss|möchte) [^.!?]{0,60}\bablehnen\b|ich bin nicht in der lage|dazu kann ich|als (?:ki|ai)\b[\w -]*[\s,]+(?:kann|darf|möchte|werde|muss) ich\b[^.!?]{0,80}\b(?:nicht|keine|nichts|ablehnen)\b"
_FR = r"(?:(?:je suis |nous sommes )?(?:vraiment )?désolée?s?|malheureusement|je regrette|toutes mes excuses)[\s,.;:—–-]*(?:mais\s+)?(?:je\b|nous\b|il m['’]est|il ne m)|je ne (?:suis|peux|puis|saurais|souhaite)\b[^.!?]{0,12}\b(?:pas|mesure)|il m['’]est impossible|je (?:refuse|dois refuser|dois décliner)|en tant qu['’ ][^.!?]{0,40}\bje ne\b"
_ES = r"(?:lo siento|lamentablemente|desafortunadamente|lo lamento|me disculpo|disculpa)[\s,.;:—–-]*(?:pero\s+)?(?:no\b|me\b)|no (?:puedo|podemos|me es posible|me siento|estoy en condiciones|soy capaz)\b|debo (?:rechazar|declinar)|me niego|como (?:ia|asistente|modelo)\b[^.!?]{0,40}\bno (?:puedo|me)\b"
_PASSIVE = r"(?:the |this )?(?:assistant|model|system) (?:has |have )?(?:chosen|declined|declines|refused|refuses|opted|decided)\b[^.!?]{0,30}|(?:request )?declined\b|no (?:answer|response|content) (?:will|can|could) be (?:generated|given|provided)|[^.!?]{0,60}\b(?:goes against|violates|is against|falls? outside)\b[^.!?]{0,60}\b(?:guidelines|policy|policies|rules|discuss|answer)\b|[^.!?]{0,40}something i['’]d rather not\b"
REFUSAL = re.compile(rf"(?:^|[.!?]\s+)[\s\"'“«*_(\[]*(?:{_EN}|{_DE}|{_FR}|{_ES}|{_PASSIVE})", re.I)
# Substrings of which every refusal has one, in lower case: a cheap look before the grammars.
_HINTS = tuple(
    "sorry|apolog|regret|cannot|can not|can't|can’t|could not|unable|not able|won't|won’t|will not|declin|comfortable|rather not|refus|not allowed|leid|leider|bedauer|entschuld|ich |wir "
    "|désol|malheureus|excuses|je |nous |impossible|siento|lament|afortunad|disculp|no pu|no po|no me|no est|no soy|rechaz|niego|debo|assistant|assistent|model|system|asistente|answer|response|guidelines|polic|rules|outside".split("|")
)
#: A question that is itself about declining.
ABOUT_DECLINING = re.compile(r"\b(?:declin|refus|turns? down|turn(?:ed|ing) down|reject|lehnt|ablehn|abgelehnt|absag|verweiger|rechaz|negar|niega)", re.I)
#: A question that asks for a word of another language.
FOREIGN_WORD = re.compile(
    r"\b(?:english|french|german|spanish|italian|portuguese|latin|greek|russian|dutch|englisch\w*|französisch\w*|deutsch\w*|spanisch\w*|italienisch\w*|latein\w*|griechisch\w*|russisch\w*"
    r"|anglais\w*|français\w*|allemande?\w*|espagnole?\w*|italien(?:ne)?|latine?|grec(?:que)?|russe|inglés|inglesa|francés|francesa|alemán|alemana|español|española|castellano|italiano|latín|griego|ruso|translat\w*|übersetz\w*|tradu\w*)\b", re.I)
# Fillers that stand for nothing, compared in lower case without brackets and marks at the edges.
FILLERS = frozenset(
    "n/a|na|n.a|n.d|nd|null|nil|tbd|tba|todo|to do|placeholder|no answer|no response|not available|not applicable|keine angabe|keine antwort|k.a|ohne antwort"
    "|sin respuesta|ninguna respuesta|pas de réponse|sans réponse|aucune réponse|undefined|nan|missing|lorem ipsum|fill in|left blank".split("|")
)
_SLOT = re.compile(r"[<\[({]+\s*(?:answer|blank|empty|none|response|text|antwort|réponse|respuesta|leer|vide|vacío|insert\b.*|your\b.*)\s*[>\])}]+", re.I)
_BLANK = "​‌‍⁠﻿\xa0"
_TOKEN = re.compile(r"[^\W_]+")
_OPTION_LABEL = re.compile(r"^\s*[(\[]?[A-Ha-h1-9][).\]:]\s+")
PRIOR = {"multi": -1.0, "single": -2.5, "option": -4.5}
#: An answer that begins an option and stops inside it; a structure left open (``pushdown``), whatever the last character is.
INSIDE_OPTION, LEFT_OPEN = 4.0, 4.0
LANGUAGE_MARGIN = 6.0
#: A run of words that counts as copied, and the questions (in words) short enough for single words to count.
RUN, SHORT = 2, 8
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def is_empty(answer: str | None, options: list[str]) -> bool:
    """Whether an answer holds nothing, or a filler; a filler word that is a real option ("None") is an answer."""
    if answer is None:
        return True
    bare = answer.translate({ord(c): None for c in _BLANK}).strip()
    if not _TOKEN.search(bare):
        return True
    if _SLOT.fullmatch(bare):
        return True
    word = bare.strip(" .,;:!?-–—_*\"'()[]<>{}").lower()
    if word in FILLERS or re.fullmatch(r"x{2,}|(?:\.\s*)+|_+", word):
        return True
    return word in ("none", "nothing", "empty", "blank", "keine", "aucun", "aucune", "ninguno", "ninguna") and bare not in options


def is_refusal(text: str | None) -> bool:
    if not text:
        return False
    low = text.lower()
    return any(h in low for h in _HINTS) and bool(REFUSAL.search(text))


def tile(a: list[str], q: list[str], least: int = 1) -> tuple[int, int]:
    """Greedy string tiling of ``a`` with runs of ``q`` of at least ``least`` tokens, longest first: tokens covered in a, in q.

    Runs are looked up by a rolling hash, at lengths halved from that of the shorter text, and extended as far as
    they agree, so that the cost is n log n in the number of tokens, however often words repeat.
    """
    free_a, free_q = [True] * len(a), [True] * len(q)
    ids: dict[str, int] = {}
    xs, ys = ([ids.setdefault(t, len(ids) + 1) for t in side] for side in (a, q))
    size = min(len(xs), len(ys))
    while size >= max(least, 1):
        where: dict[int, list[int]] = {}
        for j, h in reversed(_runs(ys, free_q, size)):
            where.setdefault(h, []).append(j)
        upto = 0
        for i, h in _runs(xs, free_a, size) if where else ():
            at = where.get(h)
            if i < upto or not at:
                continue
            while at and not (free_q[at[-1]] and free_q[at[-1] + size - 1] and xs[i : i + size] == ys[at[-1] : at[-1] + size]):
                at.pop()
            if at:
                j, n = at.pop(), size
                while i + n < len(xs) and j + n < len(ys) and free_a[i + n] and free_q[j + n] and xs[i + n] == ys[j + n]:
                    n += 1
                for k in range(n):
                    free_a[i + k] = free_q[j + k] = False
                upto = i + n
        size = max(size // 2, least) if size > least else 0
    return free_a.count(False), free_q.count(False)


def _runs(xs: list[int], free: list[bool], size: int) -> list[tuple[int, int]]:
    """(start, hash) of the runs of ``size`` free tokens."""
    out, h, n = [], 0, 0
    drop = pow(_BASE, size - 1, _MOD)
    for i, x in enumerate(xs):
        if not free[i]:
            h = n = 0
            continue
        if n == size:
            h -= xs[i - size] * drop
            n -= 1
        h = (h * _BASE + x) % _MOD
        n += 1
        if n == size:
            out.append((i - size + 1, h))
    return out


def is_copy(text: str, question: str) -> bool:
    """Whether each part of ``text`` is the question again, at most slightly changed.

    A part of up to a fifth other words, or with up to two fifths of the question left out, still is the question; a
    part that is not (an answer after the restated question) makes it no copy.
    """
    q = _TOKEN.findall(question.lower())
    if len(q) < 3:
        return [*_TOKEN.findall(text.lower())] == q and bool(q)
    parts = [p for p in (_TOKEN.findall(s) for s in text.lower().split("?")) if p]
    known = set(q)
    if not parts or any(sum(t not in known for t in p) > max(1, len(p) // 5) for p in parts):
        return False
    for p in parts:
        in_a, in_q = tile(p, q, 1 if len(q) <= SHORT else RUN)
        if len(p) - in_a > max(1, len(p) // 5) or in_q < 0.6 * len(q):
            return False
    return True


_COUNTS = pa.schema([("row", pa.string()), ("token", pa.string()), ("bucket", pa.int32()), ("inner", pa.int64()), ("final", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t for column in batch.columns for t in column.to_pylist() if t]
        counts = endings.count_tokens(texts)
        langs = language.count_languages(t for t in texts if len(t) > 12)
        yield pa.RecordBatch.from_pydict(
            {
                "row": ["token"] * len(counts) + ["language"] * len(langs),
                "token": [*counts, *(k[0] for k in langs)],
                "bucket": [None] * len(counts) + [k[1] for k in langs],
                "inner": [c[0] for c in counts.values()] + list(langs.values()),
                "final": [c[1] for c in counts.values()] + [0] * len(langs),
            },
            schema=_COUNTS,
        )


_END = pa.struct([("token", pa.string()), ("base", pa.float64()), ("single", pa.bool_()), ("multi", pa.bool_())])
_SEEN = pa.schema([("item_id", pa.int64()), ("reply_id", pa.int64()), ("about_declining", pa.bool_()), ("defect", pa.string()), ("language", pa.bool_()), ("ends", pa.list_(_END))])
SEEN = "item_id long, reply_id long, about_declining boolean, defect string, language boolean, ends array<struct<token:string,base:double,single:boolean,multi:boolean>>"


def _end_of(text: str, options: list[str]) -> dict | None:
    """The ending of an answer or explanation, with all log odds of a cut that need no counts; None for one that is plainly complete.

    What the pushdown parser finds left open is looked at first: a text that stops inside a fence, bracket or quotation is no
    complete one, also behind a full stop or a closing mark.
    """
    opened = bool(pushdown.left_open(text))
    kind, token = endings.ending(text)
    bare = text.strip()
    if kind in ("stop", "closed") and not opened:
        return None
    inside = bare[:-2]
    multi = any(s in inside for s in (". ", "? ", "! ", ".\n"))
    folded = _OPTION_LABEL.sub("", bare).lower()
    whole = any(folded == o for o in options)
    base = PRIOR["option"] if whole else PRIOR["multi"] if multi else PRIOR["single"]
    if not whole and len(folded) > 1 and any(len(o) > len(folded) and o.startswith(folded) for o in options):
        base += INSIDE_OPTION
    base += LEFT_OPEN * opened + {"open": 5.0, "marked": 2.0, "hanging": 2.5}.get(kind, 0.0)
    return {"token": token if kind in ("word", "marked", "hanging") else "", "base": base, "single": " " not in bare, "multi": multi}


def _is_foreign(text: str | None, question: list[float], q_lang: int, q_script: float, model, cache: dict) -> bool:
    if not text:
        return False
    script = language.foreign_script(text)
    if abs(script - q_script) > 0.6:
        return True
    if script > 0.5:
        return False
    words = language.words_of(text)
    s = language.scores(words, model, cache)
    best = max(range(len(s)), key=s.__getitem__)
    return best != q_lang and s[best] - s[q_lang] >= LANGUAGE_MARGIN and question[q_lang] - question[best] >= LANGUAGE_MARGIN / 2


def _look(model_ref):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = model_ref.value, {}
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _SEEN}
            for item, reply, question, options, answer, explanation in zip(*(c.to_pylist() for c in batch.columns)):
                question = question or ""
                options = [o for o in options or [] if o]
                about = bool(ABOUT_DECLINING.search(question))
                defect, foreign, ends = None, False, []
                if not about and (is_refusal(answer) or is_refusal(explanation)):
                    defect = "refusal"
                elif is_empty(answer, options):
                    defect = "empty_answer"
                elif is_copy(answer, question) or (explanation and is_copy(explanation, question)):
                    defect = "copied_question"
                else:
                    folded = [_OPTION_LABEL.sub("", o.strip()).lower() for o in options]
                    ends = [e for e in (_end_of(t, folded) for t in (answer, explanation) if t and t.strip()) if e]
                    q_words = language.words_of(question)
                    q_scores = language.scores(q_words, model, cache)
                    q_lang = max(range(len(q_scores)), key=q_scores.__getitem__)
                    script = language.foreign_script(question)
                    asks = bool(FOREIGN_WORD.search(question))
                    foreign = bool(q_words) and ((not asks and _is_foreign(answer, q_scores, q_lang, script, model, cache)) or _is_foreign(explanation, q_scores, q_lang, script, model, cache))
                for name, x in zip(out, (item, reply, about, defect, foreign, ends)):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=_SEEN)

    return look


def _refused(replies: DataFrame) -> DataFrame:
    """Ids of replies whose refusal field holds words and no filler value."""
    bare = F.lower(F.regexp_replace(F.coalesce("refusal", F.lit("")), r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", ""))
    real = bare.rlike(r"\p{L}+\s+\p{L}+") & ~bare.isin("no refusal", "not refused", "not applicable", "no refusal given", "n a")
    return replies.where(real).select(F.col("reply_id").cast("long").alias("reply_id"), F.lit(True).alias("reply_refused")).dropDuplicates(["reply_id"])


def defects(items: DataFrame, replies: DataFrame) -> DataFrame:
    """(item_id, defect_type) of the defective pairs, once per item.

    Where several defects meet, the first of refusal, empty_answer, copied_question, truncated_answer,
    wrong_language counts. A null or blank question is only checked for refusal, emptiness and truncation;
    a null explanation is no defect; null options are none. Empty tables give no rows.
    """
    narrow = items.select(
        F.col("item_id").cast("long"), F.col("reply_id").cast("long"), F.col("question").cast("string"),
        F.col("options").cast("array<string>"), F.col("answer").cast("string"), F.col("explanation").cast("string"),
    )
    narrow = spread(narrow)
    counts = cut(narrow.select("question", F.array_join("options", "\n").alias("options"), "answer", "explanation").mapInArrow(
        _count, "row string, token string, bucket int, inner long, final long"
    ))
    cells = counts.where("row = 'language'").groupBy("token", "bucket").agg(F.sum("inner").alias("n"))
    # At most BUCKETS * len(LANGS) rows, whatever the corpus.
    model = language.log_model({(r.token, r.bucket): r.n for r in cells.toLocalIterator()})
    spark = items.sparkSession
    seen = cut(narrow.mapInArrow(_look(spark.sparkContext.broadcast(model)), SEEN).dropDuplicates(["item_id"]))
    ends = seen.select("item_id", F.explode("ends").alias("e")).select("item_id", "e.*")
    asked = ends.where("token <> ''").groupBy("token").agg(F.count_if(~F.col("multi")).alias("ends"), F.count("*").alias("unmarked"))
    table = endings.token_table(counts.where("row = 'token'").select("token", "inner", "final"), asked)
    llr = F.coalesce(F.when(F.col("single"), F.col("word_llr")).otherwise(F.col("cut_llr")), F.lit(0.0))
    stopped = ends.join(table, "token", "left").groupBy("item_id").agg(F.max(F.col("base") + llr).alias("log_odds"))
    judged = seen.join(_refused(replies), "reply_id", "left").join(stopped, "item_id", "left")
    kind = (
        F.when(F.coalesce("reply_refused", F.lit(False)), F.lit("refusal"))
        .when(F.col("defect").isNotNull(), F.col("defect"))
        .when(F.col("log_odds") > 0, F.lit("truncated_answer"))
        .when(F.col("language"), F.lit("wrong_language"))
    )
    return judged.select("item_id", kind.alias("defect_type")).where("defect_type is not null")


def profile(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Defects by type: how many items, and their share of all items."""
    total = items.agg(F.count_distinct("item_id").alias("n")).first().n
    return defects(items, replies).groupBy("defect_type").agg(F.count("*").alias("items")).withColumn("share", F.col("items") / F.lit(float(max(total, 1))))
