"""Near-duplicate records with small edits (problem 5): Golay-code fuzzy hashing."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.golay import near_codes
from lodestone.tables import ensure_checkpoint_dir

#: Segments of a fingerprint, words on either side of a segment's anchor, bits of each of those words.
SEGMENTS, REACH, WORD_BITS = 10, 5, 2
#: Words of an anchor. Few words survive an edit more often than many; the code then tells apart the texts that
#: only share the phrase. Texts of fewer than SHORT words get anchors of single runs as well; of two similar texts
#: either both have one kind or both have the other.
ANCHOR, SHORT = 4, 24
#: Rows of an anchor above which it is a stock phrase or a large group: its pairs are screened by bitmaps of their runs before they are written,
#: and its texts are spread over blocks of HOT_BLOCK, each meeting each. Both ways find the same pairs.
HOT, HOT_BLOCK = 64, 8_192
#: Longs of a bitmap, 64 bits each: half of them leave six times as many pairs to be compared by their texts.
BITMAP = 8
#: Candidate texts up to which their ids (8 bytes each) are broadcast to fetch the texts; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_WORD = re.compile(r"[A-Za-z0-9]+")
_codes: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(text: str) -> list[str]:
    """Longest runs of ASCII letters and digits, lower-cased."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


def _word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and how many each text has."""
    if len(_codes) > 2_000_000:  # a worker's memory, not a limit on words: codes are computed again
        _codes.clear()
    out, lengths = [], []
    for text in texts:
        words = _words(text)
        for w in words:
            if w not in _codes:
                b = w.encode()
                _codes[w] = crc32(b) << 32 | crc32(b, 0x5BD1E995)
        out += [_codes[w] for w in words]
        lengths.append(len(words))
    return np.array(out, dtype=np.uint64), np.array(lengths, dtype=np.int64)


def _shingles(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, their first word, and how many each text has."""
    ends = np.cumsum(lengths)
    counts = np.maximum(lengths - size + 1, 0)
    at = np.arange(len(words))
    text_end = np.repeat(ends, lengths)
    first = at[at + size <= text_end]
    hashed = np.zeros(len(first), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            hashed = _mix(hashed * np.uint64(0x9E3779B97F4A7C15) + words[first + i])
    return hashed, first, counts


def _segments(words: np.ndarray, lengths: np.ndarray, run: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which texts have a run at all, their anchors, their segments): SEGMENTS of each."""
    hashed, first, counts = _shingles(words, lengths, run)
    has = counts > 0
    n = counts[has]
    anchors, segments = np.empty((len(n), SEGMENTS), dtype=np.int64), np.zeros((len(n), SEGMENTS), dtype=np.int64)
    if not len(n):
        return has, anchors, segments
    starts = (np.cumsum(counts) - counts)[has]
    text_begin, text_end = (np.cumsum(lengths) - lengths)[has], np.cumsum(lengths)[has]
    owner = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        bits = (_mix(words) >> np.uint64(7)).astype(np.int64) & ((1 << WORD_BITS) - 1)
        for k in range(SEGMENTS):
            mixed = _mix(hashed ^ np.uint64((seed + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            least = np.minimum.reduceat(mixed, starts)
            where = np.flatnonzero(mixed == least[owner])
            where = where[np.concatenate([[True], owner[where][1:] != owner[where][:-1]])]  # the first, if the run repeats
            anchors[:, k] = least.view(np.int64)
            middle = first[where] + run // 2
            for d in range(-REACH, REACH + 1):
                at = middle + d
                inside = (at >= text_begin) & (at < text_end)
                segments[:, k] = segments[:, k] << WORD_BITS | np.where(inside, bits[np.clip(at, 0, len(bits) - 1)], 0)
    return has, anchors, segments


def fingerprints(texts: list[str], size: int) -> list[tuple[int, list[int], list[int], list[int]] | None]:
    """For each text (number of distinct runs of `size` words, anchors, segments, bitmap of the runs); None below `size` words.

    Segment k has its anchor at the run of words with the least hash under the k-th mixing, so
    two texts share the anchor as often as their runs overlap. The segment is 23 bits of the
    words around the anchor: a changed word flips one of them on average.
    """
    words, lengths = _word_codes(texts)
    hashed, _, counts = _shingles(words, lengths, size)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashed, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=len(texts)).tolist()
    bitmaps = np.zeros((len(texts), BITMAP), dtype=np.uint64)
    bit = hashed % np.uint64(64 * BITMAP)
    np.bitwise_or.at(bitmaps, (owner, (bit // np.uint64(64)).astype(np.int64)), np.uint64(1) << bit % np.uint64(64))
    found: list[tuple[int, list[int], list[int], list[int]] | None] = [(n, [], [], b) if n else None for n, b in zip(distinct, bitmaps.view(np.int64).tolist())]
    short = np.where(lengths < SHORT, lengths, 0)
    for run, seed, per_text, of in ((ANCHOR, 0, lengths, words), (size, SEGMENTS, short, words[np.repeat(lengths < SHORT, lengths)])):
        has, anchors, segments = _segments(of, per_text, run, seed)
        for i, a, s in zip(np.flatnonzero(has), anchors.tolist(), segments.tolist()):
            if found[i]:
                found[i][1].extend(a)
                found[i][2].extend(s)
    return found


def _fingerprint_udf(size: int):
    @F.pandas_udf("struct<n:int,anchors:array<bigint>,segments:array<int>,bitmap:array<bigint>>")
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        found = fingerprints(texts.tolist(), size)
        return pd.DataFrame({
            "n": pd.Series([f[0] if f else 0 for f in found], dtype="int32"),
            "anchors": [f[1] if f else [] for f in found],
            "segments": [f[2] if f else [] for f in found],
            "bitmap": [f[3] if f else [] for f in found],
        })

    return fingerprint


def _near_codes_udf():
    @F.pandas_udf("array<int>")
    def codes_of(segments: pd.Series) -> pd.Series:
        codes = np.sort(near_codes(segments.to_numpy()), axis=1)
        fresh = np.concatenate([np.ones((len(codes), 1), dtype=bool), codes[:, 1:] != codes[:, :-1]], axis=1)
        return pd.Series([row[keep] for row, keep in zip(codes, fresh)])

    return codes_of


def _shingle_udf(size: int):
    @F.pandas_udf("array<bigint>")
    def shingle_set(texts: pd.Series) -> pd.Series:
        words, lengths = _word_codes(texts.tolist())
        hashed, _, counts = _shingles(words, lengths, size)
        return pd.Series([np.unique(part.view(np.int64)) for part in np.split(hashed, np.cumsum(counts)[:-1])])

    return shingle_set


def _classes(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _class, _same): rows of one class have equal texts; `_same` is a second hash that confirms it where copies are paired."""
    text = F.col(text_col)
    return items.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_class"), F.xxhash64(F.lit(SEGMENTS), text).alias("_same")).where(text.isNotNull())


def _sizes_allow(threshold: float) -> Column:
    """Sets whose sizes are further apart than the threshold cannot be similar; n is the exact number of distinct runs."""
    return (F.col("n_a") * threshold <= F.col("n_b")) & (F.col("n_b") * threshold <= F.col("n_a"))


def _bitmaps_allow(threshold: float) -> Column:
    """Each bit in which two bitmaps differ comes from a run that only one of the sets has; similar sets have few of those."""
    differ = sum((F.bit_count(F.col("m_a")[i].bitwiseXOR(F.col("m_b")[i])) for i in range(BITMAP)), F.lit(0))
    return differ * (1 + threshold) <= (F.col("n_a") + F.col("n_b")) * (1 - threshold) + 1e-6


def _in_blocks(rows: DataFrame, of: str, count: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Two sides of `rows` for a self-join by a hot key, with (i, j) to join by besides: its rows are spread over blocks by `of`, and every block meets every other and itself once.

    A row of block o stands at (o, o..blocks-1) on one side and at (0..o, o) on the other, so that no task holds a whole key.
    """
    spread = rows.withColumn("_blocks", F.ceil(F.col(count) / block).cast("int")).withColumn("_own", F.pmod(F.xxhash64(of), F.col("_blocks")).cast("int"))
    one = spread.select("*", F.col("_own").alias("i"), F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)).alias("j"))
    two = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("i"), F.col("_own").alias("j"))
    return one, two


def _met_when_hot(hot: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that meet in a key (x, code) of a hot anchor, block by block."""
    one, two = _in_blocks(hot.select("x", "_count", "_class", "n", "bitmap", F.explode("codes").alias("code")), "_class", "_count", HOT_BLOCK)
    a = one.select("x", "code", "i", "j", F.col("_class").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("m_a"))
    b = two.select("x", "code", "i", "j", F.col("_class").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("m_b"))
    met = a.join(b, ["x", "code", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & _sizes_allow(threshold) & _bitmaps_allow(threshold))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _of_several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that rows of different classes have, and of how many rows; partial aggregation keeps a hot key small."""
    return rows.groupBy(*keys).agg(F.min("_class").alias("_low"), F.max("_class").alias("_high"), F.count("*").cast("int").alias("_count")).where("_low < _high").select(*keys, "_count")


def similar_classes(rows: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links between classes of equal texts: a, b, similarity; members: _class, _same, _id)."""
    ensure_checkpoint_dir(rows.sparkSession)
    prints = rows.select("_class", "_same", "_id", _fingerprint_udf(size)("_text").alias("f")).where("f.n > 0")
    prints = prints.select("_class", "_same", "_id", "f.n", "f.anchors", "f.segments", "f.bitmap").checkpoint()
    # One row for each segment; equal anchors of different segments are kept apart by the mixing.
    parts = prints.select("_class", "n", F.explode(F.arrays_zip("anchors", "segments")).alias("s")).select("_class", "n", F.col("s.anchors").alias("x"), "s.segments")
    shared = _of_several(parts, ["x"])
    kept = parts.join(shared, "x").dropDuplicates(["x", "_class"]).checkpoint()
    keys = kept.where(F.col("_count") <= HOT).select("x", "_class", "n", F.explode(_near_codes_udf()("segments")).alias("code"))
    a = keys.select("x", "code", F.col("_class").alias("a"), F.col("n").alias("n_a"))
    b = keys.select("x", "code", F.col("_class").alias("b"), F.col("n").alias("n_b"))
    cold = a.join(b, ["x", "code"]).where((F.col("a") < F.col("b")) & _sizes_allow(threshold)).select("a", "b").distinct()
    # Bitmaps go to the few pairs of anchors that are not hot, and with the anchors that are.
    marks = prints.select("_class", "n", "bitmap").dropDuplicates(["_class"])
    cold = cold.join(marks.select(F.col("_class").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("m_a")), "a")
    cold = cold.join(marks.select(F.col("_class").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("m_b")), "b").where(_bitmaps_allow(threshold)).select("a", "b")
    hot = kept.where(F.col("_count") > HOT).join(marks.select("_class", "bitmap"), "_class").select("x", "_count", "_class", "n", "bitmap", _near_codes_udf()("segments").alias("codes"))
    pairs = cold.unionByName(_met_when_hot(hot, threshold)).distinct().checkpoint()
    ids = pairs.select(F.col("a").alias("_class")).union(pairs.select(F.col("b"))).distinct().checkpoint()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = rows.join(wanted, "_class", "left_semi").dropDuplicates(["_class"]).select("_class", _shingle_udf(size)("_text").alias("s"))
    both = pairs.join(sets.select(F.col("_class").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("_class").alias("b"), F.col("s").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    links = both.select("a", "b", common.alias("c"), (F.size("s_a") + F.size("s_b")).alias("t")).select("a", "b", (F.col("c") / (F.col("t") - F.col("c"))).alias("similarity"))
    return links.where(F.col("similarity") >= threshold), prints.select("_class", "_same", "_id")


def near_duplicate_pairs(items: DataFrame, id_col: str, text_col: str, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (id_a, id_b, similarity) with id_a < id_b whose texts share `threshold` of their word runs.

    Similarity is the number of distinct runs of `size` words that both texts have,
    divided by the number that either has. A fingerprint has SEGMENTS segments of 23 bits;
    each is decoded to its nearby Golay codewords (up to 6 keys), so that segments within
    2 bits of each other meet. A pair at the threshold has only a share of its segments
    damaged: some segment keeps its anchor and stays within 2 bits. The two texts meet in
    its key, and the exact similarity decides. The many texts of a hot anchor all meet too,
    block by block; bitmaps only drop pairs that cannot reach the threshold. Equal texts are
    one class all the way and only come apart in the result, which therefore has every pair
    of copies (block by block as well); `near_duplicate_links` and `near_duplicate_groups`
    do not grow with the square of the copies.

    Texts with fewer than `size` words (null and empty ones too) have no runs and are in no
    pair. Rows with the same id are compared by their texts, never paired with themselves.
    An empty table gives an empty result; other columns are not read.
    """
    rows = _classes(items, id_col, text_col)
    links, members = similar_classes(rows, size, threshold)
    one, two = members.select(F.col("_class").alias("a"), F.col("_id").alias("x")), members.select(F.col("_class").alias("b"), F.col("_id").alias("y"))
    across = links.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    copies = members.join(members.groupBy("_class", "_same").agg(F.count("*").cast("int").alias("_count")).where("_count > 1"), ["_class", "_same"])
    left, right = _in_blocks(copies, "_id", "_count", HOT_BLOCK)
    met = left.withColumnRenamed("_id", "x").join(right.select("_class", "_same", "i", "j", F.col("_id").alias("y")), ["_class", "_same", "i", "j"])
    met = met.where("x <> y and (i < j or x < y)")
    return across.unionByName(met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.lit(1.0).alias("similarity"))).distinct()


def near_duplicate_links(items: DataFrame, id_col: str, text_col: str, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (id_a, id_b, similarity) of the smallest ids of each class of equal texts; copies are not expanded."""
    links, members = similar_classes(_classes(items, id_col, text_col), size, threshold)
    rep = members.groupBy("_class").agg(F.min("_id").alias("rep"))
    pairs = links.join(rep.select(F.col("_class").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("_class").alias("b"), F.col("rep").alias("y")), "b")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the least node of each connected component of the edges (a, b), nodes being longs.

    Each round takes the least label of a node's neighbours, then the label of that label, so
    chains shorten by half and more. A round is checkpointed; only the number of changed
    nodes comes to the driver. Minima are combined before the shuffle: a node that a third of
    all edges touch is no hot group.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")).select("v", F.least("v", "label").alias("label")).checkpoint()
    while True:
        around = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        nearest = labels.join(around, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parents = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = nearest.join(parents, "label").select("v", "old", F.least("label", "up").alias("label")).checkpoint()
        if new.where("old <> label").limit(1).count() == 0:
            return new.select("v", "label")
        labels = new.select("v", "label")


def near_duplicate_groups(items: DataFrame, id_col: str, text_col: str, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_col, group, links): one row for each row in a group; group is its smallest id, links the rows it is linked with.

    Groups are the connected components of the links; copies of a text are linked with each
    other. Rows without a link are left out, as are those with too few words.
    """
    links, members = similar_classes(_classes(items, id_col, text_col), size, threshold)
    links = links.select("a", "b").checkpoint()
    sizes = members.groupBy("_class").agg(F.count("*").alias("n"), F.min("_id").alias("rep"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(sizes.select(F.col("_class").alias("b"), "n"), "b").groupBy(F.col("a").alias("_class")).agg(F.sum("n").alias("outside"))
    label = components(links).select(F.col("v").alias("_class"), "label")
    classes = sizes.join(outside, "_class", "left").join(label, "_class", "left").where("n > 1 or outside > 0").select("_class", F.coalesce("label", "_class").alias("label"), (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), "rep").checkpoint()
    first = classes.groupBy("label").agg(F.min("rep").alias("group"))
    placed = classes.join(first, "label").select("_class", "group", "links")
    return members.join(placed, "_class").select(F.col("_id").alias(id_col), "group", "links")
