"""Whether a documentation comment says more than the name of what it documents."""

from __future__ import annotations

import re

# Words that carry no information of their own in a comment, in four languages.
EMPTY_WORDS = set("""
    a an the this that these those it its to of for from in on at by with and or as is are be was were will can may does do did has have which when then if not no here there all any some
    function method class helper handler handlers wrapper utility util utils constructor getter setter callback routine procedure constant const variable value values object instance module component hook service
    private public protected static async internal legacy deprecated default main misc various implementation implements implement impl use used uses using does do make makes perform performs given new
    description descriptions docs doc documentation documented undocumented comment comments missing pending todo tbd fixme add goes see below above same none empty placeholder text stuff thing things section part helpers internals
    o os um uma uns umas de do da dos das para por em no na com e ou que se este esta isto função método classe auxiliar descrição pendente documentação falta
    el la los las un una unos unas del al para por en con y o que si este esta esto función método clase descripción documentación
    der die das ein eine einen einer eines dem den des und oder für von mit zu zum zur ist sind wird dies diese dieser funktion methode klasse hilfsfunktion beschreibung dokumentation fehlt
    returns return param params parameter parameters arg args argument arguments type types name names n s
""".split())  # fmt: skip

# Stock phrases that stand in for a description.
STOCK = re.compile(
    r"^(?:todo|fixme|xxx|hack|tbd|n/?a|none|\.\.\.|-+|description goes here|add (?:a )?(?:description|docs|documentation)(?: here)?|missing (?:docs|documentation|description)|no (?:docs|description|documentation)(?: yet| available)?"
    r"|\(?undocumented\)?|to be (?:documented|written|done|described)|see (?:above|below|code|name|implementation|source)|self[- ]explanatory|for internal use(?: only)?|internal use only|not (?:yet )?documented|work in progress|wip"
    r"|待补充|待完善|暂无(?:描述|说明|文档)|无(?:描述|说明)|見ての通り|説明(?:なし|待ち|を追加)|未記載|未定|설명 ?(?:없음|필요|추가)"
    r"|descrição pendente|sem descrição|a documentar|adicionar descrição|descripción pendiente|sin descripción|pendiente de documentar|beschreibung fehlt|beschreibung folgt|noch zu dokumentieren|documentation pending|description pending|docs? (?:to follow|pending)|same as (?:above|below)|generated|auto-?generated)\W*$",
    re.I,
)

_EDGE = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+!?|#!?)?\s?|\s*\*+/\s*$")
_DIRECTIVE = re.compile(
    r"^(?:eslint|tslint|jshint|jslint|jscs|prettier|biome|istanbul|c8|v8 ignore|nyc|webpack|rollup|vite|cspell|spell-?checker|noinspection|nosonar|sonar|codacy|stylelint|oxlint|deno|dprint|rome|flow|globals?\b|exported\b|@ts-|@jest|@flow|@vitest"
    r"|@__PURE__|#__PURE__|#?(?:end)?region\b|<reference|<amd|sourceMappingURL|[#@] ?sourceMappingURL|use strict|spdx-|copyright|\(c\)|©|all rights reserved|licen[cs]ed? under|@?licen[cs]e\b)",
    re.I,
)
_TASK = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|BUG|WIP|TBD|OPTIMIZE|REVIEW|NOTE TO SELF)\b")
_TAG = re.compile(r"^@\w")
_HEADING = re.compile(r"^(?:[-=#*~_+/\\.]{2,}.*|.*[-=#*~_+/\\]{3,}|section\s*:.*|#{1,6}\s.*)$", re.I)
# Disabled code: declarations, statements, calls and what ends or goes on like code.
_CODE = re.compile(
    r"^(?:const|let|var)\s+[\w${\[].*=|^return\b.*;\s*$|^(?:if|for|while|switch|catch)\s*\(|^(?:await|throw\s+new|new|yield|delete)\s+[\w$.]+\(|^(?:import|export|case|function|class|async)\b.*[;({:]\s*$"
    r"|=>|^[\w$.]+\s*[-+*|&]?=[^=]|^[\w$.]+\([^)]*\)?;?$|\w\.\w+\([^)]*\)?;?\s*$|^\}|[{}]\s*$|[)\]'\"`];\s*$"
)
_SPLIT = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？])\s*")
# Scripts that are written without spaces: a run of them has a word for about every two characters.
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_UNSPACED}]{{1,2}}|[^\W\d_{_UNSPACED}]+(?:['’][^\W\d_{_UNSPACED}]+)?")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _HUMP.findall(name)}


def _root(word: str) -> str:
    """A rough stem, enough to see a name's word in another form."""
    for end in ("ingly", "edly", "ing", "ies", "ied", "ers", "er", "ors", "or", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def prose(comment: str) -> list[str]:
    """Sentences of a comment without tags, directives, task markers, rules, headings and disabled code."""
    kept: list[str] = []
    tagged = False
    for line in comment.split("\n"):
        body = _EDGE.sub("", line).strip()
        body = _EDGE.sub("", body).strip() if body[:2] in ("/*", "//") else body
        if line.lstrip().startswith(("//", "/*")):
            tagged = False  # another comment of the run
        if not body:
            if not tagged:
                kept.append("")
            continue
        if _TAG.match(body):
            tagged = True
            continue
        if tagged or _DIRECTIVE.match(body) or _TASK.match(body) or _HEADING.match(body):
            continue
        bare = re.sub(r"`[^`]*`", "x", body)
        if _CODE.search(bare):
            continue
        kept.append(body)
    paragraphs = "\n".join(kept).split("\n\n")
    return [s.strip() for p in paragraphs for s in _SPLIT.split(" ".join(p.split())) if s.strip()]


def says_something(name: str, comment: str) -> bool:
    """At least one sentence has two words that neither the name has nor every comment has.

    In scripts without spaces two characters count as a word.
    """
    known = {_root(w) for w in name_words(name)} | name_words(name)
    for sentence in prose(comment):
        if STOCK.match(sentence):
            continue
        words = [w.lower() for w in _WORD.findall(sentence)]
        if len(words) < 2:
            continue
        telling = {w for w in words if w not in EMPTY_WORDS and w not in known and _root(w) not in known}
        if len(telling) >= 2:
            return True
    return False
