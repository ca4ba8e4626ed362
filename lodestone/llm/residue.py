"""Template residue and error-page text (problem 8): a multi-pattern automaton, coverage by sentence and by text."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import residue_phrases as P

#: A sentence is residue if phrases cover this share of its letters, general words beside them not counted.
COVERAGE = 0.5
#: A text is left out as a whole if residue covers this share of its letters.
EXCLUDE = 0.3
#: So many filler words make a sentence filler (with COVERAGE).
FILLER_WORDS = 4

_SLOT = re.compile(P.SLOTS)
_SLOT_I = re.compile(r"\[(?:insert|your|enter|add|todo:?|tbd:?|inserir|insertar|einfügen)\b[^\]\n]*\]|<(?:insert|your)[ _-][a-z][^<>\n]*>", re.I)
_SLOT_SIGNS = ("{", "%", "$", "__", "@@", "[", "<", "Invalid Date", "undefined", "null", "NaN")
_FENCE = re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"``[^`\n]+``|`[^`\n]+`")
_TAG = re.compile(r"<[^<>\n]+>")
_SENTENCE = re.compile(r"(?<=[.!?;…])[\"')\]]*\s+|\n")
_QUOTE = re.compile(r"\n[ \t]*>[ \t]?")
_ODD = re.compile(r"[\d/]|[^\x00-\x7f]")
_VALUE = re.compile(r'"[^"\s]*[\d/][^"\s]*"')
_LETTERS = re.compile(r"[^\W\d_]+")
_GENERAL = frozenset(f"{P.SMALL} {P.PAGE}".split())
_NO_LETTER = re.compile(r"[\W\d_]+")
_CODE_LINE = re.compile(
    r"^\s*(?:import\b.*from|export\b|(?:async\s+)?function\b|const\b|let\b|var\b|class\b|interface\b|type\s+\w+\s*=|return\b|if\s*\(|for\s*\(|while\s*\(|switch\s*\(|case\b|try\b|throw\b|await\b|//|/\*|[}\])]+[;,)]*\s*$)|[;{]\s*$|=>|^\s*[\w$.]+\([^)]*\)?[;,]?$"
)


@cache
def _automaton():
    """One automaton over all phrases; built once per Python worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, text in P.STRONG.items():
        for phrase in re.split(r"[|\n]", text):
            if phrase := phrase.strip():
                found.add_word(phrase, (len(phrase), kind))
    for word in f"{P.LATIN} {P.MASH}".split():
        if word not in found:
            found.add_word(word, (len(word), "word"))
    found.make_automaton()
    return found


def _without_code(text: str) -> str:
    """The text; of a document that is source code as a whole only the blocks (between empty lines) without a line of code.

    A line is code by its form, or inside a comment between /* and */; a bullet is not.
    """
    blocks, count, code, inside = [[False]], 0, 0, False
    for line in text.split("\n"):
        if not line.strip():
            blocks.append([inside])
            continue
        opens = inside or line.lstrip().startswith("/*")
        reads = opens or _CODE_LINE.search(line) is not None
        inside = opens and line.rfind("*/") <= line.rfind("/*")
        blocks[-1][0] |= reads
        blocks[-1].append(line)
        count, code = count + 1, code + reads
    if count <= 2 or code < 0.6 * count:
        return text
    return "\n\n".join("\n".join(lines) for reads, *lines in blocks if not reads)


def _letters(text: str) -> int:
    return len(_NO_LETTER.sub("", text))


def _sentence_kind(sentence: str) -> str | None:
    """The kind of residue that covers most of what a sentence says, or None."""
    plain = _TAG.sub(" ", sentence).lower()
    # Numbers, ids and paths say nothing about the kind of text.
    plain = " ".join(plain.split() if not _ODD.search(plain) else (w for w in _VALUE.sub(" ", plain).split() if not (any(c.isdigit() for c in w) and not w.isdigit()) and "/" not in w))
    spans, kinds, filler = [], set(), 0
    for end, (length, kind) in _automaton().iter(plain):
        start = end + 1 - length
        if (start and plain[start].isalnum() and plain[start - 1].isalnum()) or (end + 1 < len(plain) and plain[end].isalpha() and plain[end + 1].isalnum()):
            continue
        spans.append((start, end + 1))
        if kind == "word":
            filler += 1
        else:
            kinds.add(kind)
    if not kinds and filler < FILLER_WORDS:
        return None
    covered, upto, rest = 0, 0, []
    for start, end in sorted(spans):
        if end > upto:
            rest.append(plain[upto:start] if start > upto else "")
            covered += _letters(plain[max(start, upto) : end])
            upto = end
    rest.append(plain[upto:])
    content = sum(len(w) for w in _LETTERS.findall(" ".join(rest)) if w not in _GENERAL)
    if covered == 0 or covered < COVERAGE * (covered + content):
        return None
    return min(kinds) if kinds else "filler"


def residue_of(text: str | None) -> tuple[str, float] | None:
    """(kind, share of the text's letters that stand in residue), or None for real content."""
    if text is None or not text.strip():
        return None
    slots = any(sign in text for sign in _SLOT_SIGNS) and (_SLOT.search(text) or _SLOT_I.search(text))
    prose = _INLINE.sub(" ` ", _FENCE.sub("\n", text)) if "`" in text or "~~~" in text else text
    prose = _without_code(prose)
    sentences = [s for s in _SENTENCE.split(_QUOTE.sub("\n", prose)) if s.strip()]
    kinds = [_sentence_kind(s) for s in sentences]
    if slots:
        # A slot makes its sentence residue.
        kinds = ["slot" if _SLOT.search(s) or _SLOT_I.search(s) else k for s, k in zip(sentences, kinds)]
        if "slot" not in kinds and (_SLOT.search(prose) or _SLOT_I.search(prose)):
            kinds[0] = "slot"  # one that a sentence's end divides
    covered = [k for k in kinds if k]
    if not covered:
        return None
    share = sum(_letters(s) for s, k in zip(sentences, kinds) if k) / max(_letters(text), 1)
    return "slot" if "slot" in covered else covered[0], round(min(share, 1.0), 6)


def detect_residue(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` whose text is residue in whole or in part: (id_col, kind, share).

    One pass without a shuffle. An automaton over all phrases reads each text sentence by
    sentence, without code (fenced, in backticks, or the blocks of a text that is code as a
    whole). A sentence is residue if phrases cover COVERAGE of it. `kind` is slot, error,
    login, wait, script, empty or filler; `share` is the share of the text's letters that
    stand in residue sentences: from EXCLUDE on, `excluded` has the text.

    Null, empty and blank texts are no residue. Repeated rows come out as often as they
    come in. An empty table gives an empty result; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for pdf in batches:
            found = [(i, *r) for i, t in zip(pdf["_id"], pdf["_text"]) if (r := residue_of(t))]
            yield pd.DataFrame(found, columns=["_id", "kind", "share"]).astype({"_id": pdf["_id"].dtype})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    return rows.mapInPandas(scan, f"_id {id_type}, kind string, share double").withColumnRenamed("_id", id_col)


def excluded(docs: DataFrame, id_col: str, text_col: str, share: float = EXCLUDE) -> DataFrame:
    """The rows of `docs` to leave out: those whose residue covers `share` of the text; a line of it in a long text does not."""
    return detect_residue(docs, id_col, text_col).where(F.col("share") >= share)
