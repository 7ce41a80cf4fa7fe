"""Column builders for text, dates, numbers and vectors. All are built-in expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop lists that results depend on.
ENGLISH_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "call", "calls", "find", "for", "from", "have", "how", "in", "is", "it", "mention", "mentions", "of", "on", "or", "show", "that", "the", "this", "to", "was", "we", "what", "which", "with")
SEARCH_STOPWORDS = ("and", "are", "call", "calls", "find", "for", "have", "mention", "mentions", "show", "the", "which", "with")
QUERY_STOPWORDS = ("and", "are", "break", "breakdown", "calls", "count", "down", "find", "for", "have", "how", "many", "mention", "mentions", "show", "the", "which", "with")
SCHEMA_STOPWORDS = tuple(
    """about account accounts after agent also analysis analytics and any are area ask before between but call calls can cannot could
    customer customers data did does for from have how if into issue main many mentioned need needs next not our past please raw report
    review should show some speaker start that the their this today turn understand use want wants way we what when where which whether
    with would will you your team""".split()
)

TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
#: A token without the possessive, which is passed over.
_BARE_TOKEN = r"([a-z0-9]+(?:'(?!s(?![a-z]))[a-z]+)?)(?:'s(?![a-z]))?"
EMPTY = ("", "not_mentioned")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without(tokens: Column, stop: tuple[str, ...], least: int) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(*stop))


def english_tokens(text: str | Column) -> Column:
    """Lower-case words and numbers, possessives cut, one-letter tokens and stop words left out; order and repeats kept."""
    found = F.regexp_extract_all(F.translate(F.lower(_col(text)), "_", " "), F.lit(_BARE_TOKEN), F.lit(1))
    return _without(found, ENGLISH_STOPWORDS, 2)


#: Scripts that are written without spaces: Han, kana with its marks for length and repetition, and Hangul.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\u30fc\u3005"


def script_tokens(text: str | Column) -> Column:
    """``english_tokens``, and of every run in a script without spaces its overlapping pairs of characters (a run of one is itself), all in the order of the text. Texts
    without such runs have the tokens that ``english_tokens`` gives."""
    found = F.regexp_extract_all(F.translate(F.lower(_col(text)), "_", " "), F.lit(f"[{_UNSPACED}]+|{_BARE_TOKEN.replace('(', '(?:', 1)}"), F.lit(0))

    def cut(run: Column) -> Column:
        letters = F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0))
        pairs = F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters) - 1), lambda a, b: F.concat(a, b))
        return F.when(F.size(letters) < 2, letters).otherwise(pairs)

    unspaced = lambda t: t.rlike(f"^[{_UNSPACED}]")
    latin = lambda t: F.regexp_replace(t, "'s$", "")
    whole = F.flatten(F.transform(found, lambda t: F.when(unspaced(t), cut(t)).otherwise(F.array(latin(t)))))
    return F.filter(whole, lambda t: unspaced(t) | ((F.length(t) >= 2) & ~t.isin(*ENGLISH_STOPWORDS)))


def normalized_query(text: str | Column) -> Column:
    """The tokens of a query, one space between."""
    return F.array_join(english_tokens(text), " ")


def suggested_values(text: str | Column, most: int = 8) -> Column:
    """The first distinct words of a query that could be values of a field: punctuation off, letters, digits and _ only, over two characters, no stop word."""
    words = F.split(F.regexp_replace(F.lower(_col(text)), "[-/]", " "), r"\s+")
    return F.slice(F.array_distinct(_without(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")), QUERY_STOPWORDS, 3)), 1, most)


def first_text(*texts: str | Column) -> Column:
    """The first that isn't blank, white space collapsed; empty if there is none."""
    return F.coalesce(*[F.nullif(collapsed(t), F.lit("")) for t in texts], F.lit(""))


def choice(text: str | Column, allowed: tuple[str, ...], fallback: str) -> Column:
    """The trimmed lower-case text where it is allowed."""
    c = F.lower(F.trim(_col(text)))
    return F.when(c.isin(*allowed), c).otherwise(fallback)


def normalize_label(text: str | Column) -> Column:
    c = F.lower(F.trim(_col(text)))
    return F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def normalize_identifier(text: str | Column) -> Column:
    c = normalize_label(text)
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("field_"), c)).otherwise(c)


def content_tokens(text: str | Column) -> Column:
    found = F.transform(F.regexp_extract_all(_col(text), F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), normalize_label)
    return _without(found, SCHEMA_STOPWORDS, 3)


def query_terms(text: str | Column) -> Column:
    return _without(F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0)), QUERY_STOPWORDS, 3)


def lexical_terms(text: str | Column, stop: tuple[str, ...] = SEARCH_STOPWORDS) -> Column:
    """A set: distinct terms, by first place."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(_without(found, stop, 3))


def collapsed(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def snippet(text: str | Column, limit: int = 220) -> Column:
    c = collapsed(text)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("...")))


def contains_any(text: str | Column, terms: list[str]) -> Column:
    """Whether any term is a substring of the lower-cased text."""
    low, out = F.lower(_col(text)), F.lit(False)
    for t in terms:
        out = out | low.contains(t.lower())
    return F.coalesce(out, F.lit(False))


def short_hash(text: str | Column, digits: int) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, digits)


def chunk_ref(chunk_id: str | Column) -> Column:
    return F.concat(F.lit("chunk:"), _col(chunk_id))


def ref_chunk(ref: str | Column) -> Column:
    return F.regexp_replace(_col(ref), "^chunk:", "")


def format_turn(index: str | Column, speaker: str | Column, text: str | Column) -> Column:
    return F.concat(F.lit("turn:"), _col(index).cast("string"), F.lit(" speaker:"), _col(speaker), F.lit(": "), _col(text))


def parse_date(text: str | Column) -> Column:
    """Date of the first ten characters in ISO form; null otherwise."""
    c = _col(text).cast("string")
    return F.when(F.length(c) >= 10, F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def numeric_value(c: str | Column, kind: str) -> Column:
    """Double of a number or of a numeric string; booleans, lists, NaN and other text are null."""
    c = _col(c)
    if kind in ("boolean",) or kind.startswith(("array", "map", "struct")):
        return F.lit(None).cast("double")
    if kind == "string":
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a norm is 0; an error where lengths differ."""
    a, b = _col(a), _col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) == F.size(b), norm).otherwise(F.raise_error(F.lit("vectors of different length")).cast("double"))
    return F.when(same == 0, 0.0).otherwise(dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)
