"""Quality rules (operator 6): line-first cleaning.

Each line is judged by itself; lines that fail are taken out; a document goes when too much of its text went with them
or when its base figures fail. Edge cases: a null text is an empty text, has no words and fails the base rule
(n_words < 20); stock phrases are those of four languages, see BOILERPLATE; empty lines are neither judged nor counted and stay where they are; repeated rows are judged alike; a
column of the input that has the name of a result column is replaced; an empty table gives an empty table. Nothing
depends on other rows, so any partitioning and any text length give the same result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from silt.llm.common import add_arrow_columns, as_bytes
from silt.llm.textops import batches, covered, mix, per_doc, windows, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected if the lines taken out held more than this share of its words.
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"

_SPACES = " \t\n\x0b\x0c\r"
_WORD = re.compile(f"[^{_SPACES}]+")
_ENDS = tuple(".!?:;…。！？\"'”’»)]")
_LACED = re.compile(r"[#*$%&|<>]{2,}(?=[ \t\x0b\x0c\r]|$)")
_SEPARATOR = re.compile(r"(?:^|[ \t])[|»›>•·](?=[ \t]|$)")
#: Stock phrases of web pages in English, Spanish, French and German; each stands with a part of it in lower case that is
#: looked for first.
BOILERPLATE = (
    ("rights reserved", r"all rights reserved"), ("copyright", r"copyright (?:©|\(c\)|[12][0-9]{3})"),
    ("terms ", r"terms (?:of (?:use|service)|and conditions)"), ("privacy policy", r"privacy policy"), ("cookie ", r"cookie (?:policy|settings)"),
    ("cookies", r"(?:uses?|accept) cookies"), ("enable javascript", r"enable javascript"), ("lorem ipsum", r"lorem ipsum"),
    ("powered by ", r"powered by "), ("subscribe to our", r"subscribe to our"), ("sign up for our", r"sign up for our"),
    ("skip to ", r"skip to (?:main )?content"), ("click here", r"click here"), ("ed under ", r"licen[cs]ed under (?:the|a|cc)\b"),
    ("released under the ", r"released under the "),
    ("derechos reservados", r"todos los derechos reservados"), ("de privacidad", r"pol[ií]tica de privacidad"), ("de cookies", r"pol[ií]tica de cookies"),
    ("condiciones", r"t[eé]rminos y condiciones"), ("haga clic aqu", r"haga clic aqu[ií]"), ("se a nuestro", r"suscr[ií]b[ae]n?se a nuestro"),
    ("droits réservés", r"tous droits réservés"), ("de confidentialité", r"politique de confidentialité"), ("légales", r"mentions légales"),
    ("utilisation", r"conditions (?:générales )?d['’]utilisation"), ("cliquez ici", r"cliquez ici"), ("abonnez-vous", r"abonnez-vous à notre"),
    ("rechte vorbehalten", r"alle rechte vorbehalten"), ("datenschutzerkl", r"datenschutzerklärung"), ("nutzungsbedingungen", r"nutzungsbedingungen"),
    ("klicken sie hier", r"klicken sie hier"), ("abonnieren sie unser", r"abonnieren sie unser"), ("verwendet cookies", r"verwendet cookies"),
    ("utiliza cookies", r"utiliza cookies"), ("utilise des cookies", r"utilise des cookies"),
)
_PARTS = tuple(part for part, _ in BOILERPLATE)
_BOILERPLATE = re.compile("|".join(phrase for _, phrase in BOILERPLATE), re.I)

LINE_RULES = ("punctuation", "navigation", "boilerplate", "shouting", "stutter")


def line_fault(line: str) -> str | None:
    """The first rule that a line with words fails, None if it passes.

    punctuation: it doesn't end in a sentence mark and has five words or more, or a third of its words end in two or
    more symbols; navigation: a separator for every five words; boilerplate: a stock phrase; shouting: seven in ten
    words are in upper case, in five words or more; stutter: half of its words repeat the word before.
    """
    words = _WORD.findall(line)
    n = len(words)
    if n >= 2 and 5 * len(_SEPARATOR.findall(line)) >= n:
        return "navigation"
    if 3 * len(_LACED.findall(line)) >= n:
        return "punctuation"
    if n >= 5:
        if not line.rstrip(_SPACES).endswith(_ENDS):
            return "punctuation"
        if 10 * sum(map(str.isupper, words)) >= 7 * n:
            return "shouting"
        if 2 * sum(a == b for a, b in zip(words, words[1:])) >= n:
            return "stutter"
    low = line.lower()
    return "boilerplate" if any(part in low for part in _PARTS) and _BOILERPLATE.search(line) else None


def clean(text: str) -> tuple[str, int, int]:
    """The text without the lines that fail, how many failed, and the words in them."""
    kept, lines, words = [], 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES) and line_fault(line):
            lines += 1
            words += len(_WORD.findall(line))
        else:
            kept.append(line)
    return "\n".join(kept), lines, words


def repeat_words(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its words, and those within windows that occur twice or more in it."""
    total, repeated = [], []
    for a, b in batches(texts):
        w = words_of(texts[a:b])
        start, h = windows(w, width)
        doc = np.repeat(np.arange(b - a), w.count)
        key = mix(h + mix(doc[start].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = start[np.concatenate([order[1:][same], order[:-1][same]])]
        total.append(w.count)
        repeated.append(per_doc(w.first, covered(w.hash.size, np.unique(twice), width)))
    return (np.concatenate(total), np.concatenate(repeated)) if total else (np.empty(0, int), np.empty(0, int))


FIELDS = [
    *(StructField(n, LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    StructField("base_failed", BooleanType(), False),
    StructField("kept", BooleanType(), False),
    *(StructField(n, LongType(), False) for n in ("n_lines_removed", "n_words_removed")),
    StructField("clean_text", StringType(), False),
]


def judge(texts: pa.Array) -> list:
    raw = as_bytes(texts)
    n_words, n_repeat = repeat_words(raw)
    out: list[list] = [[] for _ in range(6)]
    for t in raw:
        s = t.decode("utf-8", "replace")
        seen, dup = set(), 0
        for line in s.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(_SPACES):
                seen.add(line)
        text, lines, words = clean(s)
        row = (len(s) - sum(map(s.count, _SPACES)), sum(map(s.count, SYMBOLS)), dup, lines, words, text)
        for col, x in zip(out, row):
            col.append(x)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (100 * np.array(out[4], np.int64) <= MAX_LOST_PERCENT * n_words)
    return [n_words, *out[:3], n_repeat, failed, kept, *out[3:]]


def line_first_cleaning(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the figures, the verdict and clean_text, the text without the lines that fail; one row per row."""
    return add_arrow_columns(df, [text], FIELDS, judge)
