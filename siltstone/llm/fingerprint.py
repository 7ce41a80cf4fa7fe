"""Document fingerprints: threshold-scaled sketches.

A text's sketch is the set of all hashes of its five-word shingles that fall below a fixed
fraction of the hash range. Sketches of parts merge by union, and since the same
hashes survive everywhere, sketches of texts of very unequal length still tell how much of the short one
is contained in the long one. The fingerprint writes the sketch as a string.

DataFrame operations only.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One of so many hashes is retained.
SCALE = 4
_BITS = 48
#: Fan-out of the tree of quantiles.
_FAN = 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def sketch(words: Column, scale: int = SCALE, n: int = SHINGLE) -> Column:
    """Sorted distinct retained shingle hashes. Fewer than n words are one shingle, none give none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    full = lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(n)])
    hashed = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, full))
    cut = F.transform(hashed, lambda h: F.shiftrightunsigned(h, 64 - _BITS))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda h: h < (1 << _BITS) // scale)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two parts together."""
    return F.array_sort(F.array_union(a, b))


def written(sk: Column, text: Column) -> Column:
    """The fingerprint: a short digest of the text, then the retained hashes in hex."""
    return F.concat(F.substring(F.sha2(text, 256), 1, 16), F.lit(":"), F.array_join(F.transform(sk, lambda h: F.lower(F.lpad(F.hex(h), _BITS // 4, "0"))), ""))


def read(fingerprint: Column) -> Column:
    """The sketch in a fingerprint."""
    hexes = F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit("[0-9a-f]{12}"), F.lit(0))
    return F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("long"))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard similarity; of two empty sketches 1 for the same text, else 0."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.when(same, 1.0).otherwise(0.0)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 0 if a retains none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0).cast("double")


def _dealt(src: DataFrame, rows: int) -> DataFrame:
    """``src`` (id, text) with h (a hash of the text) and a cell of about ``rows`` documents that rises with (id, h); rows
    without an id come last. Cells end at quantiles of the ids; an id that fills several
    cells is dealt to these by h. The quantiles stand in a tree of three levels of 64, so a row is compared with 192 of them at most."""
    spark = src.sparkSession
    n, lost = src.agg(F.count("id"), F.count_if(F.col("id").isNull())).first()
    m = min(_FAN**3, n // rows) + 1
    listed = lambda some, kind="bigint": F.split(F.lit(",".join(map(repr, some))), ",").cast(f"array<{kind}>") if some else F.array().cast(f"array<{kind}>")
    cuts = (src.agg(F.percentile_approx("id", listed([k / m for k in range(1, m)], "double"), F.lit(max(10_000, 4 * m))).alias("q")).first()["q"] or []) if m > 1 else []
    top, mid, low = (listed(cuts[::step]) for step in (_FAN**2, _FAN, 1))
    less = lambda some: F.size(F.filter(some, lambda c: F.coalesce(c < F.col("id"), F.lit(False))))
    part = lambda some, k: F.slice(some, (F.col(k) * _FAN + 1).cast("int"), F.lit(_FAN))
    t = src.withColumn("h", F.xxhash64("text", F.lit(29)))
    t = t.withColumn("_a", F.greatest(less(top) - 1, F.lit(0)))
    t = t.withColumn("_b", F.col("_a") * _FAN + F.greatest(less(part(mid, "_a")) - 1, F.lit(0)))
    before = F.col("_b") * _FAN + less(part(low, "_b"))
    often = {k: v for k, v in Counter(cuts).items() if v > 1}
    same = F.lit(0)
    if often:
        more = spark.createDataFrame(list(often.items()), "_cut bigint, _times int")
        t = t.join(F.broadcast(more), F.col("id") == F.col("_cut"), "left")
        same = F.coalesce(F.col("_times"), F.lit(0))
    u = F.shiftrightunsigned("h", 33) / F.lit(float(1 << 31))
    cell = F.when(F.col("id").isNull(), m + F.floor(u * (lost // rows + 1))).otherwise(before + F.floor(u * (same + F.lit(1))))
    return t.select("id", "text", "h", cell.cast("long").alias("cell"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 512) -> DataFrame:
    """(id, text, next): every text with that of the next document by ascending id, after the last the
    first. Null texts are empty. Equal ids follow by a hash of the text, then by text; rows without an id come last, likewise.

    Rows are dealt to ranges of about ``rows`` documents; each range is
    ordered by itself, with the first document of the range after it put at its end. Only the list of ranges (one
    narrow row per range that isn't empty) is ordered as a whole."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = _dealt(src, rows)
    order = Window.orderBy("cell")
    grid = src.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    grid = grid.select("cell", F.coalesce(F.lag("cell").over(order), F.max("cell").over(Window.partitionBy())).alias("before"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "h", "text")
    firsts = src.groupBy("cell").agg(F.min(key).alias("f")).join(grid, "cell")
    guests = firsts.select(F.lit(None).cast("long").alias("id"), F.col("f.text").alias("text"), F.lit(None).cast("long").alias("h"), F.col("before").alias("cell"), F.lit(1).alias("guest"))
    w = Window.partitionBy("cell").orderBy("guest", F.col("id").asc_nulls_last(), "h", "text")
    both = src.withColumn("guest", F.lit(0)).unionByName(guests)
    return both.withColumn("next", F.lead("text").over(w)).where("guest = 0").select("id", "text", "next")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text, whose last quarter (floor) is replaced by the first as many
    code points of the next document, and says how alike they are.

    Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited), one row per input row; see ``with_next`` for order, ties and nulls."""
    t = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    t = t.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.col("next"), F.lit(1), quarter)))
    for name in ("text", "edited", "next"):
        t = t.withColumn(f"w_{name}", words_of(F.col(name)))
    t = t.select("id", "n_chars", "text", "edited", (F.col("text") == F.col("edited")).alias("same_e"), (F.col("text") == F.col("next")).alias("same_n"), *[sketch(F.col(f"w_{n}")).alias(f"s_{n}") for n in ("text", "edited", "next")])
    return t.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        written(F.col("s_text"), F.col("text")).alias("fingerprint"),
        written(F.col("s_edited"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("s_text"), F.col("s_edited"), F.col("same_e")).alias("near_edited"),
        likeness(F.col("s_text"), F.col("s_next"), F.col("same_n")).alias("near_next"),
        containment(F.col("s_text"), F.col("s_edited")).alias("contained_edited"),
    )
