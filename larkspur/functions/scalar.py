"""Column helpers: seeded scores, words, vectors, dates, prices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns used by the text functions.
WORD = r"[\p{L}\p{N}]+"
SPACE_WORD = r"[^ \n\t]+"
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}"
# Fixed value: tokens a word in English text, as published.
TOKENS_PER_WORD = 1.33


def rounded(col: Column, digits: int) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def seeded_hash(seed: str, *ids) -> Column:
    """Reproducible random key per row: hex md5 of the seed and the id columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]))


def seeded_score(seed: str, *ids) -> Column:
    """Reproducible integer 0..65535 per row."""
    return F.conv(F.substring(seeded_hash(seed, *ids), 1, 4), 16, 10).cast("int")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def split_tokens(text: Column) -> Column:
    """Words and single separators in order, blanks dropped."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def emails(text: Column) -> Column:
    """E-mail addresses; the pattern is only tried on texts that hold an @."""
    found = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0)))


def estimated_tokens(text: Column) -> Column:
    """Words times 1.33, rounded up to a whole token."""
    return F.ceil(F.round(word_count(text) * F.lit(TOKENS_PER_WORD), 6)).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by a space; empty array when there are fewer than n tokens."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1)))
    return F.coalesce(
        F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")),
        F.array().cast("array<string>"),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clip_lower(col: Column, floor: float = 0) -> Column:
    """``greatest`` skips nulls, so a null must be kept explicitly."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(floor)))


def ratio(num: Column, den: Column) -> Column:
    """Division where a zero denominator gives 0.0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


# The published token rule for images (85 flat, 170 for each tile of 512 x 512).
def image_tokens(width: Column, height: Column, detail: str = "high") -> Column:
    """85 tokens flat at low detail; at high detail plus 170 per 512 x 512 tile."""
    if detail == "low":
        return F.lit(85).cast("long")
    return (F.lit(85) + F.lit(170) * F.ceil(width / 512) * F.ceil(height / 512)).cast("long")


def daytime(hour: Column, as_published: bool = False) -> Column:
    """Night 22-6, Morning 6-12, Afternoon 12-18, Evening otherwise. ``as_published`` uses
    22 <= hour < 6, which no hour meets, so that the night hours become Evening."""
    late, early = hour >= 22, hour < 6
    night = (late & early) if as_published else (late | early)
    return (
        F.when(night, "Night")
        .when((hour >= 6) & (hour < 12), "Morning")
        .when((hour >= 12) & (hour < 18), "Afternoon")
        .otherwise("Evening")
    )
