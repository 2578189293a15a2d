"""Scalar functions of catalogs and titles, as column expressions; Python only where Spark has no function for it."""

from __future__ import annotations

import ast
import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Articles that may lead a title, or follow it after a comma.
ARTICLES = ("the", "a", "an", "les", "la", "le", "il", "das", "der", "die", "el", "l'")


def normalize_key(text: Column) -> Column:
    """Lower case without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def fold_ascii(text: Column) -> Column:
    """Compatibility decomposition less all that isn't ASCII; Spark has no function for it, so texts that need it go through Python, others stay."""
    return F.when(has_non_ascii(text), F.pandas_udf(folded, "string")(F.when(has_non_ascii(text), text))).otherwise(text)


def unaccented(text: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c)[0] != "M")
        core = plain.strip("".join({c for c in plain if unicodedata.category(c) == "Zs"}))
        start = plain.find(core)
        return " " * start + core + " " * (len(plain) - start - len(core))

    return text.map(lambda x: None if x is None else one(x))


def strip_accents(text: Column) -> Column:
    """As SQL's function: canonical decomposition less its marks, other letters stay; separators at the ends are spaces, which SQL trims alike. Only ``fold_ascii`` is what titles are matched by."""
    return F.when(has_non_ascii(text), F.pandas_udf(unaccented, "string")(F.when(has_non_ascii(text), text))).otherwise(text)


def has_non_ascii(text: Column) -> Column:
    return text.rlike("[^\\x00-\\x7F]")


def strip_article(text: Column) -> Column:
    return F.regexp_replace(text, f"^({'|'.join(ARTICLES)}) ", "")


def title_key(title: Column, fold: bool = True) -> Column:
    """Key of a title: ASCII, lower case, ``&`` as and, one leading article less, letters and digits only."""
    plain = fold_ascii(title) if fold else title
    spelled = F.trim(F.regexp_replace(F.lower(plain), "&", " and "))
    return F.regexp_replace(strip_article(spelled), "[^a-z0-9]", "")


def title_base(title: Column) -> Column:
    """The title without the year in brackets at its end."""
    return F.regexp_replace(F.trim(title), "\\s*\\(\\d{4}\\)\\s*$", "")


def title_variants(title: Column) -> Column:
    """All spellings of a title such as "Name, The (Other Name) (1995)": the whole without brackets, as of "(500) Days of Summer", the
    part outside of brackets, and each part within; the latter without a.k.a., and with a trailing article put first."""
    base = title_base(title)
    inner = F.regexp_extract_all(base, F.lit("\\(([^)]*)\\)"), 1)
    plain = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "\\([^)]*\\)", "")), "^a\\.k\\.a\\.\\s*", "")
    front = lambda x: F.regexp_replace(plain(x), f"^(.*), ({'|'.join(x.capitalize() for x in ARTICLES)})$", "$2 $1")
    return F.array_distinct(F.filter(F.concat(F.array(F.regexp_replace(base, "[()]", "")), F.transform(F.concat(F.array(base), inner), front)), lambda x: x != ""))


def title_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, "\\((\\d{4})\\)\\s*$", 1), F.lit("")).try_cast("int")


def extract_year(text: Column) -> Column:
    """First year from 1900 to 2099."""
    return F.nullif(F.regexp_extract(text, "((?:19|20)\\d{2})", 1), F.lit("")).try_cast("int")


def to_numeric(text: Column) -> Column:
    """The number that is left without all but digits, points and minus signs; null if none is."""
    return F.regexp_replace(text.cast("string"), "[^0-9.\\-]", "").try_cast("double")


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(\\d+)", 1), F.lit("")).try_cast("int")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def name_tokens(names: Column) -> Column:
    """Whole names between bars or commas, trimmed, in lower case; repeats stay."""
    return F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), "[|,]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def genre_tokens(genres: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(genres, F.lit(""))), F.lit("[^,|\\s]+"), 0)


def word_tokens(text: Column) -> Column:
    """Words of two or more letters, digits or underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?U)\\b\\w\\w+\\b"), 0)


def literal_parts(cell: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            names = ast.literal_eval(x.strip())
        except (ValueError, SyntaxError, TypeError, AttributeError, MemoryError, RecursionError):
            return None
        return " | ".join(y for y in (str(n).strip() for n in names) if y) if isinstance(names, (list, tuple)) else None

    return cell.map(one)


def literal_names(cell: Column) -> Column:
    """Names of a cell that is a list literal, joined by bars; quotes and commas within names need the literal's grammar."""
    return F.pandas_udf(literal_parts, "string")(cell)


def actors(cell: Column) -> Column:
    """A list or tuple literal, or a comma list without brackets and single quotes, as names joined by bars; the cell itself if the comma list gives no names."""
    able = cell.rlike("^\\s*[\\[(]|['\"]")
    listed = F.array_join(F.filter(F.transform(F.split(F.regexp_replace(cell, "[\\[\\]']", ""), ","), lambda x: F.trim(x)), lambda x: x != ""), " | ")
    return F.coalesce(F.when(able, literal_names(F.when(able, cell))), F.nullif(listed, F.lit("")), F.trim(cell))


def runtime_bucket(minutes: Column) -> Column:
    return F.when(minutes < 90, "short").when(minutes <= 120, "medium").when(minutes <= 150, "long").when(minutes > 150, "epic")


def percent_match(score: Column) -> Column:
    """Rounded half up."""
    return F.floor(score * 100 + 0.5).cast("int")


def palette_index(text: Column, colors: int = 5) -> Column:
    """h = 31 h + code in 32-bit wrap-around over the text, its absolute value modulo ``colors``."""
    wrap = lambda h: F.pmod(h + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return (F.abs(F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: wrap(h * 31 + c))) % colors).cast("int")


def toggled(items: Column, item: Column | str) -> Column:
    """The list without the item if it has it, else with it at its end."""
    item = F.lit(item) if isinstance(item, str) else item
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def toggled_rating(rating: Column, star: Column | int) -> Column:
    star = F.lit(star) if isinstance(star, int) else star
    return F.when(rating == star, F.lit(0)).otherwise(star)


def with_tag(tags: Column, tag: str) -> Column:
    """The tags with one more, unless it is blank or there."""
    return F.array_union(tags, F.array(F.lit(tag.strip()))) if tag.strip() else tags


def meta_line(*parts: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def valid_ids(liked: Column, n_items: int) -> Column:
    """Ids from 0 to n_items - 1, once each, in the order of first mention."""
    return F.array_distinct(F.filter(liked, lambda x: (x >= 0) & (x < n_items)))


def version_stamp(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMddHHmmss")


def tag_choices(preset: Column, own: Column) -> Column:
    """The preset tags, then those of one's own that aren't among them."""
    return F.array_union(preset, own)


def etag(*columns: Column | str) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def closest(asked: list[str], keys: list[str], cutoff: float) -> list[tuple[str, str, float]]:
    """(key, its most similar of ``keys``, the similarity) where that is ``cutoff`` or more; of equally similar ones the last in order."""
    if not asked or not keys:
        return []
    letters = sorted(set("".join(keys)) | set("".join(asked)) | {""})
    place = {c: i for i, c in enumerate(letters)}
    counts = lambda words: np.array([np.bincount([place[c] for c in w], minlength=len(letters)) for w in words]).reshape(len(words), -1)
    keys = sorted(keys, reverse=True)
    held, sizes, out = counts(keys), np.array([len(k) for k in keys]), []
    for word, own in zip(asked, counts(asked)):
        bound = 2 * np.minimum(held, own).sum(axis=1) / np.maximum(sizes + len(word), 1)
        matcher, best = difflib.SequenceMatcher(b=word), (None, cutoff)
        for at in np.argsort(-bound, kind="stable"):
            if bound[at] < best[1]:
                break
            matcher.set_seq1(keys[at])
            ratio = matcher.ratio()
            if ratio > best[1] or ratio == best[1] and (best[0] is None or keys[at] > best[0]):
                best = keys[at], ratio
        if best[0] is not None:
            out.append((word, *best))
    return out


def first_genres(genres: Column, n: int = 2) -> Column:
    """The first genres of a comma list."""
    return F.slice(F.filter(F.transform(F.split(genres, ","), lambda x: F.trim(x)), lambda x: x != ""), 1, n)


def one_decimal(number: Column) -> Column:
    """A rating as text with one decimal; null for none."""
    return F.when(number.isNotNull(), F.format_string("%.1f", number))


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same ids, in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def coalesced_year(year: Column, other: Column) -> Column:
    """A catalog's year, else the other set's if it is positive."""
    return F.coalesce(year, F.when(other > 0, other))
