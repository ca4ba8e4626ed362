"""Text functions as Spark column expressions (no Python in the data path)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopwords of the tokenizer.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "this", "that",
    "it", "as", "with", "by", "be", "are", "from", "at", "if", "we", "you", "return", "const",
)

_MARK = "\u0001"


#: A word with an inner hump, and the same with the end mark of its second copy.
_HUMPED = "(?<![A-Za-z0-9])(?:[A-Z]*+[a-z0-9]++[A-Z]|[A-Z]{2,}[a-z])[A-Za-z0-9]*+"
_END = "\u0004"


def _camel_marked(text: Column, ahead: str = "") -> Column:
    """A mark between the humps of camel-cased words: `parseHTTPBody` -> parse|HTTP|Body."""
    marked = F.regexp_replace(text, f"([a-z0-9])([A-Z]){ahead}", f"$1{_MARK}$2")
    return F.regexp_replace(marked, f"([A-Z]+)([A-Z][a-z]){ahead}", f"$1{_MARK}$2")


def tokenize(text: Column) -> Column:
    """Search tokens of a text: array<string>.

    Words are runs of ASCII letters and digits, lower-cased; a camel-cased word is
    followed by its parts. Tokens of one character and stopwords are left out.
    Null gives null, an empty text an empty array.

    Camel-cased words are doubled in the text and the second copy is taken apart there,
    by regular expressions over the whole text; only lower-casing and the filter look at
    tokens one by one.
    """
    clean = F.translate(text, _MARK + _END, "  ")
    doubled = F.regexp_replace(clean, f"({_HUMPED})", f"$1 $1{_END}")
    parts = _camel_marked(doubled, f"(?=[A-Za-z0-9{_MARK}]*+{_END})")
    words = F.split(parts, "[^A-Za-z0-9]+")
    return F.filter(F.transform(words, F.lower), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def word_tokens(word: str) -> list[str]:
    """What `tokenize` makes of one run of ASCII letters and digits, for tasks that count many words in Python."""
    parts = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", word)).split(" ")
    tokens = [t.lower() for t in ([word, *parts] if len(parts) > 1 else parts)]
    return [t for t in tokens if len(t) > 1 and t not in STOPWORDS]


def explode_tokens(text: Column) -> Column:
    """One row for each token; drop the null row of a text without tokens.

    An outer generator: for a plain one the optimizer would filter by the array's size first and tokenize twice.
    """
    return F.explode_outer(tokenize(text))


def token_count(text: Column) -> Column:
    """size(tokenize(text)) by three regular expressions, without building the tokens.

    One counts whole words, the others the parts of words that have several;
    null counts as 0. Far cheaper than `tokenize` on long texts.
    """
    clean = F.coalesce(text, F.lit(""))
    # Only ASCII case is folded, as in the tokenizer.
    not_stop = f"(?!(?i:{'|'.join(STOPWORDS)})(?![A-Za-z0-9]))"
    word = f"(?<![A-Za-z0-9]){not_stop}[A-Za-z0-9]{{2,}}+"
    # Words with an inner hump, alone; all other text needs no second look.
    humped = F.regexp_extract_all(clean, F.lit(_HUMPED), F.lit(0))
    parts = F.regexp_count(_camel_marked(F.array_join(humped, " ")), F.lit(word))
    return (F.regexp_count(clean, F.lit(word)) + parts).cast("long")
