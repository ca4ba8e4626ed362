"""Evaluation texts leaking into training text (problem 7): an FM-index per shard of the corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.fm_index import FMIndex

#: Words of a searched phrase. A passage of 20 words with one in eight edited keeps 6 in a row.
PHRASE = 5
#: Words of a shard's index, and characters of the items that are searched in it at once.
SHARD_WORDS, ITEM_CHARS = 1_000_000, 4_000_000

_ASCII_WORD, _WORD = re.compile(r"[a-z0-9]+"), re.compile(r"[^\W_]+")
# A short tag, whatever is in it; a tag of any length with attributes; the address of a link in Markdown.
_TAG = re.compile(r"""</?[A-Za-z][^<>\n]{0,80}>|<[A-Za-z][\w:.-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))+\s*/?>""")
_ADDRESS = re.compile(r"\]\([^()\s]+\)")
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def words_of(text: str) -> list[str]:
    """Words without regard to case, punctuation, markup, entities, ligatures, accents and hidden characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _ADDRESS.sub("]", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", text.translate(_HIDDEN))
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)).casefold())


@dataclass
class Phrases:
    """The phrases of a block of items: word numbers (0 separates, 1 is any other word), and where each occurs."""

    numbers: dict[str, int]
    items: list[tuple[object, list[int]]]
    phrases: np.ndarray
    places: list[list[tuple[int, int]]]


def phrases_of(items: list[tuple[object, str]]) -> Phrases:
    numbers: dict[str, int] = {}
    coded, at = [], defaultdict(list)
    for item_id, text in items:
        coded.append((item_id, [numbers.setdefault(w, len(numbers) + 2) for w in words_of(text or "")]))
    for i, (_, codes) in enumerate(coded):
        for p in range(len(codes) - PHRASE + 1):
            at[tuple(codes[p : p + PHRASE])].append((i, p))
    return Phrases(numbers, coded, np.array(list(at), dtype=np.int64).reshape(-1, PHRASE), list(at.values()))


def _edits(a: list[int], b: list[int]) -> int:
    """Least number of changed, missing or added words between two short runs."""
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _ends(a: list[int], b: list[int], most: int) -> list[tuple[int, int, int]]:
    """For 0, 1, ... edits: (edits, words of a, words of b) that a run can be extended by."""
    best = {0: (0, 0)}
    row = list(range(len(b) + 1))
    for i in range(len(a) + 1):
        if i:
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a[i - 1] != y))
        for j, cost in enumerate(row):
            # An extension ends on a word that both have.
            if cost <= most and i and j and a[i - 1] == b[j - 1] and (cost not in best or i > best[cost][0]):
                best[cost] = (i, j)
    return [(e, *best[e]) for e in sorted(best)]


def _runs(hits: list[tuple[int, int]]) -> list[list[int]]:
    """[first word, end word, first word in the text] of hits joined along their diagonals."""
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for i, d in sorted(hits):
        run = open_.get(i - d)
        if run and i <= run[1]:
            run[1] = i + PHRASE
        else:
            run = open_[i - d] = [i, i + PHRASE, d]
            runs.append(run)
    return sorted(runs)


def passage(item: list[int], doc: list[int], hits: list[tuple[int, int]], least: int, one_in: int) -> tuple[int, int, int, int] | None:
    """The longest passage of an item in a text: (words, edits, first word, end word), or None.

    `hits` are the places (in the item, in the text) of phrases that both have. Phrases on
    one diagonal join into runs, runs into chains; a passage is a stretch of a chain with
    at least `least` words of the item and at most one edit in `one_in` of them. A stretch
    without a common phrase has an edit in each PHRASE words, so no more than `reach` words
    with the edits that the whole item allows.
    """
    runs = _runs(hits)
    reach = PHRASE * (len(item) // one_in) + PHRASE - 1
    end_from = [0] * (len(runs) + 1)
    for s in range(len(runs) - 1, -1, -1):
        end_from[s] = max(end_from[s + 1], runs[s][1])
    best = None
    for s, start in enumerate(runs):
        if best is not None and end_from[s] - start[0] + 2 * reach <= best[0]:
            continue
        chain, edits = start, 0
        following = runs[s + 1 :]
        stretch = [(start, 0)]
        while following:
            # The run that continues the chain at the least cost.
            found = None
            for r in following:
                i, d = chain[1], chain[2] + chain[1] - chain[0]
                lap = max(0, i - r[0], d - r[2])
                gaps = r[0] + lap - i, r[2] + lap - d
                if r[1] - r[0] <= lap or max(gaps) > reach or (found is not None and (abs(gaps[0] - gaps[1]), r[0]) >= found[:2]):
                    continue
                cost = _edits(item[i : r[0] + lap], doc[d : r[2] + lap])
                if found is None or (cost, r[0]) < found[:2]:
                    found = (cost, r[0], r)
            if found is None:
                break
            edits += found[0]
            if edits > len(item) // one_in:
                break
            chain = found[2]
            stretch.append((chain, edits))
            following = [r for r in following if r[0] > chain[0]]
        for last, cost in reversed(stretch):
            if best is not None and last[1] - start[0] + 2 * reach <= best[0]:
                break
            i, d, j, e = start[0], start[2], last[1], last[2] + last[1] - last[0]
            spare = min(len(item), j - i + 2 * reach) // one_in - cost
            if spare < 0 or j - i + 2 * reach < least:
                continue
            side = PHRASE * (spare + 1)
            for e1, a1, b1 in _ends(item[max(0, i - side) : i][::-1], doc[max(0, d - side) : d][::-1], spare):
                for e2, a2, b2 in _ends(item[j : j + side], doc[e : e + side], spare - e1):
                    n, total = j - i + a1 + a2, cost + e1 + e2
                    if n >= least and total * one_in <= n and (best is None or (n, -total) > best[:2]):
                        best = (n, -total, d - b1, e + b2)
    return best and (best[0], -best[1], best[2], best[3])


def passages(item: list[int], doc: list[int], hits: list[tuple[int, int]], least: int, one_in: int, few: int) -> list[tuple[int, int, int, int]]:
    """All passages of an item in a text, the longest first; none overlaps another in the text."""
    found = []
    while len({i for i, _ in hits}) >= few and (best := passage(item, doc, hits, least, one_in)):
        found.append(best)
        hits = [(i, d) for i, d in hits if d + PHRASE <= best[2] or d >= best[3]]
    return found


def search_shard(ids: list, docs: list[list[str]], block: Phrases, least: int, one_in: int):
    """(id, item id, words, edits, first word, end word) of every leak in the texts of a shard."""
    get = block.numbers.get
    coded = [[get(w, 1) for w in d] for d in docs]
    text = np.fromiter((c for d in coded for c in (*d, 0)), dtype=np.int64)
    if not len(text) or not len(block.phrases):
        return
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in coded])])
    index = FMIndex(text, len(block.numbers) + 2)
    low, high = index.search(block.phrases)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts) + low[phrase]
    places = index.locate(rows)
    doc = np.searchsorted(starts, places, side="right") - 1
    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for p, d, at in zip(phrase.tolist(), doc.tolist(), (places - starts[doc]).tolist()):
        for item, position in block.places[p]:
            hits[d, item].append((position, at))
    # e edits leave n - e words in e + 1 runs at most, and a run of m words has m - PHRASE + 1 phrases.
    few = max(1, min(n - n // one_in - (PHRASE - 1) * (n // one_in + 1) for n in range(least, 8 * least)))
    for (d, item), found in hits.items():
        for leak in passages(block.items[item][1], coded[d], found, least, one_in, few):
            yield ids[d], block.items[item][0], *leak


def without_formulas(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text): the items without an opening, up to the first colon, that another item has too."""
    text = F.col(text_col)
    own = items.select(F.col(item_col).alias("_item"), text.alias("_text"), F.when(F.contains(text, F.lit(":")), F.split(text, ":", 2)[0]).alias("_head")).distinct()
    shared = own.where("_head is not null").groupBy("_head").agg(F.countDistinct("_item").alias("_n")).where("_n > 1")
    rest = F.expr("substring(_text, length(_head) + 2)")
    return own.join(shared, "_head", "left").select("_item", F.when(F.col("_n").isNotNull(), rest).otherwise(F.col("_text")).alias("_text"))


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, least: int = 20, one_in: int = 8) -> DataFrame:
    """Texts that hold `least` words of an item in unbroken order, one in `one_in` of them edited at most.

    Returns (id_col, item_col, words, edits, start_word, end_word), a row for each passage;
    passages of one item in one text do not overlap. Every partition of the corpus is indexed
    in shards of about SHARD_WORDS words (texts stay whole), without a shuffle and in one pass:
    backward search finds all phrases of PHRASE words of the items, sampled suffix positions
    tell where, and the places of one item in one text are aligned.

    Items go to the tasks in blocks of about ITEM_CHARS characters, which a task searches one
    after the other; the driver holds one block at a time. An opening formula that several
    items share is not searched. Null, empty and short texts or items have no leak; repeated
    rows come out as often as they come in; an empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    types = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"_id {types[0]}, _item {types[1]}, words int, edits int, start_word int, end_word int"
    plain = without_formulas(items, item_col, item_text).where(F.col("_text").isNotNull())
    total = plain.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_CHARS))
    sent = []
    for b in range(blocks):
        own = plain.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b) if blocks > 1 else plain
        sent.append(spark.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()]))  # about ITEM_CHARS characters
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())

    def search(batches):
        one = phrases_of(sent[0].value) if blocks == 1 else None
        ids, texts, size = [], [], 0
        for pdf in batches:
            for i, t in zip(pdf["_id"], pdf["_text"]):
                words = words_of(t)
                ids.append(i)
                texts.append(words)
                size += len(words)
                if size >= SHARD_WORDS:
                    yield leaks(ids, texts, one)
                    ids, texts, size = [], [], 0
        yield leaks(ids, texts, one)

    def leaks(ids, texts, one):
        found = [leak for block in sent for leak in search_shard(ids, texts, one or phrases_of(block.value), least, one_in)]
        return pd.DataFrame(found, columns=["_id", "_item", "words", "edits", "start_word", "end_word"])

    return rows.mapInPandas(search, schema).withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_col)


def removal_spans(leaks: DataFrame, id_col: str) -> DataFrame:
    """(id_col, start_word, end_word, words): what to cut from each text, overlapping and touching passages of all items merged.

    A text has at most as many passages as the items have phrases in it. Repeated rows merge.
    """
    known = leaks.select(id_col, "start_word", "end_word").distinct()
    before = Window.partitionBy(id_col).orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start_word") > F.max("end_word").over(before), F.lit(True))
    upto = Window.partitionBy(id_col).orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, 0)
    spans = known.withColumn("_new", opens.cast("int")).withColumn("_span", F.sum("_new").over(upto))
    merged = spans.groupBy(id_col, "_span").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return merged.select(id_col, "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("words"))
