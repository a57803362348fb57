"""Scalar cleaning and text functions, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions.answers import longest_prefix

# Texts that stand for a missing value.
NULL_MARKERS = ("", "-", "—", "/", "nan", "none", "n/a", "na", "not reported")
# Weights of the relevance terms.
RELEVANCE_TERMS = {
    "xps": 5, "x-ray photoelectron": 5, "n 1s": 5, "o 1s": 5, "binding energy": 4, "deconvol": 4, "peak fit": 4,
    "atomic concentration": 3, "survey spectrum": 3, "surface composition": 3, "chemical state": 3,
}
#: What counts as a number: no suffixes, separators, hexadecimals or names.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_double(c: Column | str) -> Column:
    """A text as a finite double, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return finite(F.when(c.rlike(NUMBER), stripped(c).try_cast("double")))


def clean_marker(c: Column | str) -> Column:
    """The text, or NULL where it is a marker for missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.lower(stripped(c)).isin(*NULL_MARKERS), c)


def first_integer(c: Column | str) -> Column:
    """The first run of digits as a bigint, without leading zeros."""
    return F.nullif(F.regexp_extract(c, r"[0-9]+", 0), F.lit("")).try_cast("bigint")


IDENTITY = r"(?i)^(NF|RO)-([0-9]+)-([0-9]+)-([NO])$"


def spectrum_identity(stem: Column | str) -> Column:
    """struct(dataset, reference, sample, element) of a file stem, NULL if it isn't one."""
    stem = F.col(stem) if isinstance(stem, str) else stem
    part = lambda k: F.regexp_extract(stem, IDENTITY, k)
    return F.when(
        stem.rlike(IDENTITY),
        F.struct(F.upper(part(1)).alias("dataset"), part(2).cast("int").alias("reference"), part(3).cast("int").alias("sample"), F.upper(part(4)).alias("element")),
    )


def normalize_doi(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", "")
    found = F.regexp_extract(bare, r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]+", 0)
    return F.nullif(F.regexp_replace(found, r"[.,;)]+$", ""), F.lit(""))


def document_key(doi: Column | str, external_id: Column | str, title: Column | str) -> Column:
    """doi:…, else id:…, else a hash of the title."""
    hashed = F.substring(F.sha2(F.lower(stripped(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))), 256), 1, 24)
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), F.concat(F.lit("id:"), F.nullif(external_id if isinstance(external_id, Column) else F.col(external_id), F.lit(""))), F.concat(F.lit("title:"), hashed))


def hash_id(*parts: Column | str, length: int = 32) -> Column:
    """A stable id: the first hex digits of the SHA-256 of the parts, joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def safe_filename(c: Column | str, limit: int = 120) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[<>:\"/\\|?*\x00-\x1f]", "_"), r"^[ ._]+|[ ._]+$", ""), r"\s+", " ")
    cut = F.substring(plain, 1, limit)
    return F.regexp_replace(F.when(cut == "", "document").otherwise(cut), r"[ .]+$", "")


# Credentials and bearer tokens to black out, a supplement's address, a number in a performance unit.
CREDENTIAL = r"(?i)(api[_-]?key|access[_-]?token|insttoken|authorization)(\s*[=:]\s*)[^\s&,;]+"
BEARER = r"(?i)Bearer\s+[A-Za-z0-9._-]+"
SUPPLEMENT = r"^(10\.1073/pnas\.[a-z0-9.]+?)/-/dcsupplemental.*$"
UNCALIBRATED = r"(?i)\d(?:[\d.,]*\d)?\s*(?:%|％|LMH|L\s*[·/]?\s*m[-−⁻]?[²2]|mL|bar[-−⁻]?[¹1])"


def redacted(c: Column | str, limit: int = 2000) -> Column:
    """Credentials in key=value form and bearer tokens, blacked out; then the length cap."""
    keys = F.regexp_replace(c, CREDENTIAL, "$1$2[REDACTED]")
    return F.substring(F.regexp_replace(keys, BEARER, "Bearer [REDACTED]"), 1, limit)


def article_group(c: Column | str) -> Column:
    """The article a DOI group stands for: a supplement's tail doesn't make another article."""
    return F.regexp_replace(F.lower(stripped(c)), SUPPLEMENT, "$1")


def occurrences(text: Column, term: str | Column) -> Column:
    """Non-overlapping places of a term in a text."""
    term = F.lit(term) if isinstance(term, str) else term
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def relevance(text: Column | str, terms: dict[str, int] = RELEVANCE_TERMS) -> Column:
    lower = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return reduce(add, [occurrences(lower, t) * w for t, w in terms.items()]).cast("bigint")


def token_score(text: Column, words: Column) -> Column:
    """Over distinct words of more than two characters: how often each occurs, four times at most, summed."""
    useful = F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))
    lower = F.lower(text)
    return F.aggregate(useful, F.lit(0).cast("bigint"), lambda s, w: s + F.least(F.lit(4).cast("bigint"), occurrences(lower, F.lower(w))))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9-]{2,30})"), 1)


def uncalibrated(claim: Column | str) -> Column:
    """Whether a claim states a number in a performance unit."""
    return (F.col(claim) if isinstance(claim, str) else claim).rlike(UNCALIBRATED)


def local_time(c: Column | str, zone: str = "+08:00", unknown: str = "unknown") -> Column:
    """A UTC ISO time as MM-dd HH:mm of the zone."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(c), zone), "MM-dd HH:mm"), F.lit(unknown))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from one ISO time to another, never negative; 0 where either can't be read."""
    micros = F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))
    return F.coalesce(F.greatest(F.lit(0.0), micros / 1e6), F.lit(0.0))


def progress_ratio(*pairs: tuple[Column, Column]) -> Column:
    """done / total of the first pair with a positive total, done kept within 0 and total."""
    return F.coalesce(*[F.when(total > 0, F.least(F.greatest(F.coalesce(done, F.lit(0.0)), F.lit(0.0)), total) / total) for total, done in pairs])


def looked_up(code: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, code), code)


def remapped(path: Column | str, old: str, new: str) -> Column:
    """A path under `old` moved to `new`; others stay."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def flattened_counters(json: Column | str, fields: tuple[str, ...], groups: tuple[str, ...]) -> Column:
    """Allowed numeric counters of a JSON object, those of nested groups as group.name, as a map of doubles."""
    number = lambda m: F.map_filter(F.transform_values(m, lambda _, v: finite_double(v)), lambda k, v: v.isNotNull() & k.isin(*fields))
    none = F.create_map().cast("map<string,string>")
    top = number(F.coalesce(F.from_json(json, "map<string,string>"), none))

    def below(group: str) -> Column:
        inner = number(F.coalesce(F.from_json(F.get_json_object(json, f"$.{group}"), "map<string,string>"), none))
        return F.transform_keys(inner, lambda k, _: F.concat(F.lit(f"{group}."), k))

    return F.map_concat(top, *map(below, groups))


#: The formula commands that the display knows.
MATH_COMMANDS = ("alpha", "beta", "cdot", "frac", "int", "mathrm", "sqrt", "sum", "text", "times")


def formulas(text: Column | str) -> Column:
    """Formulas between double or single dollars on one line."""
    return F.regexp_extract_all(text, F.lit(r"\$\$?([^$\n]+)\$\$?"), 1)


def math_issue(formula: Column) -> Column:
    """What is wrong with a formula: unbalanced braces, an embedded heading, an unknown command; else NULL."""
    braces = F.regexp_extract_all(F.regexp_replace(formula, r"\\[{}\\]", ""), F.lit(r"([{}])"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("broken"))
    walked = F.aggregate(
        braces,
        start,
        lambda s, b: F.struct((s["depth"] + F.when(b == "{", 1).otherwise(-1)).alias("depth"), (s["broken"] | (s["depth"] + F.when(b == "{", 1).otherwise(-1) < 0)).alias("broken")),
    )
    unknown = F.array_except(F.regexp_extract_all(formula, F.lit(r"\\([A-Za-z]+)"), 1), F.array(*map(F.lit, MATH_COMMANDS)))
    return (
        F.when(walked["broken"] | (walked["depth"] != 0), "unbalanced")
        .when(formula.rlike(r"(?m)^\s*(#{1,6}\s|[-*+]\s+\*\*)"), "heading")
        .when(F.size(unknown) > 0, "unknown command")
    )


def longest_json(text: Column | str) -> Column:
    """JSON inside a model's answer: its fence removed, the whole or else the longest prefix from the first bracket that parses; NULL if none does."""
    bare = F.regexp_replace(F.regexp_replace(stripped(text), r"(?i)^```(json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull(), bare), longest_prefix(bare))
