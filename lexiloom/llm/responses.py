"""Broken prompt and response pairs (problem 3).

Each response gets the first defect that fits:

``empty``           no letter or digit;
``refusal``         a longest common subsequence with a refusal template covers at
                    least 3/4 of the template, and the response does not carry the
                    names and numbers of its prompt;
``copy``            the prompt again: three-word shingles and the longest common
                    subsequence of words say so, whatever label stands before it;
``other_language``  mostly Latin script, or words with letters Russian does not have;
``truncated``       no end mark although the prompt has one, or far fewer words than
                    prompts of that length get.

Null texts are empty texts; records with status ``error`` are left out; repeated
records are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
END = ".!?…"
CLOSING = " \t\r\n\"'»”’)]}*_"
TEMPLATE_SHARE, COPY_SHARE, SHINGLE_SHARE, SHORT_SHARE = 0.75, 0.7, 0.5, 0.7

# What refusals say, by language.
TEMPLATES = """
не хватает данных чтобы ответить на этот вопрос
я не имею права работать с таким содержанием
я не могу перевести этот текст
я не могу выполнить этот запрос
помочь с этим запросом не получится
такой перевод противоречит моим правилам
я не в состоянии выполнить этот запрос
я отказываюсь переводить данное предложение
выполнить перевод невозможно
как языковая модель я не
i cannot translate this text
i can t help with that request
this content goes against my guidelines
i am unable to provide this translation
i m not able to comply with this instruction
i won t be able to answer that
as an ai language model i cannot
бұл сұрауды орындай алмаймын
бұл өтінішке жауап беруге құқығым жоқ
мен мұны аудармаймын
бұл мәтінді аудара алмаймын
я не можу перекласти цей текст
bu metni çeviremem
bu isteği yerine getiremem
bu matnni tarjima qila olmayman
бул текстти которо албайм
""".strip().splitlines()
_TEMPLATES = [t.split() for t in TEMPLATES]

RUSSIAN = set("абвгдеёжзийклмнопрстуфхцчшщъыьэюя")
_PLAIN = str.maketrans({"ә": "а", "ғ": "г", "қ": "к", "ө": "о", "ұ": "у", "ү": "у", "һ": "х", "і": "и", "ң": "нг"})


def words(s: str) -> list[str]:
    return WORD.findall(s.lower())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & at.get(w, 0)
        v = (v + m | v - m) & full
    return len(a) - v.bit_count()


def shingles(ws: list[str], k: int = 3) -> set[tuple[str, ...]]:
    k = min(k, len(ws)) or 1
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def anchors(s: str) -> list[str]:
    """Names, numbers and Latin words of a prompt as a Russian text would spell them."""
    out = []
    for w in WORD.findall(s):
        if w[0].isupper() or w[0].isdigit() or w.isascii():
            out.append(w.lower().replace("ңғ", "нг").translate(_PLAIN))
    return out


def carried(source: str, target: list[str]) -> float:
    """Share of the prompt's anchors that stand in the response; 0 without anchors."""
    a = anchors(source)
    have = {w.translate(_PLAIN)[:6] for w in target}
    return sum(x[:6] in have for x in a) / len(a) if a else 0.0


def is_refusal(source: str, target: list[str]) -> bool:
    have = set(target)
    for t in _TEMPLATES:
        if sum(w in have for w in t) >= TEMPLATE_SHARE * len(t) and lcs(t, target) >= TEMPLATE_SHARE * len(t):
            return carried(source, target) < 0.5
    return False


def is_copy(source: list[str], target: list[str]) -> bool:
    if not source:
        return False
    common = lcs(source, target)
    if common < COPY_SHARE * min(len(source), len(target)) or common < 0.4 * len(source):
        return False
    s, t = shingles(source), shingles(target)
    return common >= COPY_SHARE * len(source) or len(s & t) >= SHINGLE_SHARE * min(len(s), len(t))


def is_other_language(source: str, text: str) -> bool:
    """Not Russian: mostly Latin script, or words with letters outside the Russian alphabet:
    one is enough where the prompt's names are not carried over, else over 15 %."""
    ws = words(text)
    cyrillic = [w for w in ws if any("а" <= ch <= "ӿ" for ch in w)]
    letters = sum(len(w) for w in cyrillic)
    latin = sum(len(w) for w in ws if w[0].isalpha()) - letters
    if latin > letters:
        return True
    odd = sum(any(ch.isalpha() and ch not in RUSSIAN for ch in w) for w in cyrillic)
    return odd > 0.15 * len(cyrillic) or odd > 0 and carried(source, ws) < 0.4


def is_truncated(source: str, source_words: list[str], target: str, target_words: list[str]) -> bool:
    if len(target_words) < SHORT_SHARE * len(source_words) and len(source_words) > 4:
        return True
    s, t = source.rstrip(CLOSING), target.rstrip(CLOSING)
    return s[-1:] in END and s != "" and t[-1:] not in END


def defect(source: str | None, target: str | None) -> str | None:
    source, target = source or "", target or ""
    tw = words(target)
    if not tw:
        return "empty"
    if is_refusal(source, tw):
        return "refusal"
    sw = words(source)
    if is_copy(sw, tw):
        return "copy"
    if is_other_language(source, target):
        return "other_language"
    if is_truncated(source, sw, target, tw):
        return "truncated"
    return None


def defects(records: DataFrame, id_col="record_id", source="source", target="translation", status="status") -> DataFrame:
    """(id, defect) of each defective pair whose status is not ``error``; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            ids, kinds = [], []
            for i, s, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                d = defect(s, t)
                if d:
                    ids.append(i)
                    kinds.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=[id_col, "defect"])

    kept = records.where(F.coalesce(F.col(status), F.lit("")) != "error")
    return kept.select(F.col(id_col).cast("long"), source, target).mapInArrow(run, f"`{id_col}` long, defect string")


def rates(records: DataFrame, by: str = "model") -> DataFrame:
    """Number of records of each defect per group (``none`` where there is none)."""
    d = records.where(F.coalesce("status", F.lit("")) != "error").join(defects(records), "record_id", "left")
    return d.groupBy(by, F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"))
