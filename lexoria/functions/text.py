"""Text normalisation, hashing and small string functions."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that fold to one ASCII letter, for expressions that stay in the JVM.
_FOLD_FROM = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
_FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
FOLD = str.maketrans(_FOLD_FROM, _FOLD_TO)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, Latin accents folded: the tokens of lexical search."""
    return F.regexp_extract_all(F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO), F.lit("[a-z0-9]+"), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case, Latin accents folded, other runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO), "[^a-z0-9]+", " "))


@functools.cache
def _marks() -> str:
    """A pattern of all combining marks: those of a class other than 0."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    known = set(marks)
    starts, ends = [c for c in marks if c - 1 not in known], [c for c in marks if c + 1 not in known]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]+"


@F.arrow_udf(T.StringType())
def normalize_text(s: pa.Array) -> pa.Array:
    """Compatibility decomposition, combining marks dropped, lower case, runs outside a-z0-9 to one
    space. The JVM has no decomposition function, hence Arrow's, over whole columns."""
    plain = pc.replace_substring_regex(pc.utf8_normalize(s, "NFKD"), _marks(), "")
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(plain), "[^a-z0-9]+", " "), " ")


def slug(text: Column, default: str = "source") -> Column:
    kept = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def ascii_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(text), " ", "-"), r"^-+|-+$", "")


def unified(text: Column) -> Column:
    """The text with every line end as a line feed."""
    return F.when(F.contains(text, F.lit("\r")), F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))).otherwise(text)


def lines(text: Column) -> Column:
    """The lines of a text, whatever ends them: an empty one behind a line end at its end."""
    return F.split(unified(text), "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 with line ends unified."""
    return F.sha2(unified(text), 256)


def candidate_id(*parts: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.left(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(24)))


def opaque_id(value: Column, prefix: str) -> Column:
    """prefix-hash; a value that is already one stays."""
    done = value.rlike(f"^{prefix}-[0-9a-f]{{24}}$")
    return F.when(done, value).otherwise(F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(value, 256), F.lit(24))))


def estimated_tokens(text: Column) -> Column:
    """Half the UTF-8 bytes, rounded up; 0 for an empty text."""
    return F.ceil(F.octet_length(text) / 2).cast("long")


def word_count(text: Column) -> Column:
    """Runs outside white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def clean_page_title(title: Column) -> Column:
    """The head before the first separator, if it has at least four characters."""
    out = F.trim(title)
    for mark in (" - ", " | ", " — ", " – "):
        head = F.trim(F.split_part(out, F.lit(mark), F.lit(1)))
        out = F.when(out.contains(mark) & (F.length(head) >= 4), head).otherwise(out)
    return out


def url_filename(url: Column) -> Column:
    """url__host__last-segment__ten hex digits of SHA-1."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    last = F.regexp_extract(path, r"([^/]+)$", 1)
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("host"))
    return F.concat(F.lit("url__"), slug(host), F.lit("__"), slug(last, "index"), F.lit("__"), F.left(F.sha1(url), F.lit(10)))


def title_from_url(url: Column) -> Column:
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    last = F.trim(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), "[-_]+", " "))
    return F.when(last != "", last).otherwise(F.try_parse_url(url, F.lit("HOST")))


def is_url(value: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(value, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(value, F.lit("HOST")).isNotNull(), F.lit(False))


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """Equal to an entry, or below the rest of an entry that begins with ``*.``; an empty list
    allows all."""
    if not allowed:
        return F.lit(True)
    ok = F.lit(False)
    for entry in allowed:
        low = entry.strip().lower().rstrip(".")
        ok = ok | (F.lower(host).endswith(low[1:]) if low.startswith("*.") else F.lower(host) == low)
    return F.coalesce(ok, F.lit(False))


def content_doc_type(content_type: Column) -> Column:
    """The document type of a content type, by the first substring that fits; else web."""
    low, out = F.lower(content_type), None
    for part, kind in (("pdf", "pdf"), ("html", "html"), ("markdown", "md"), ("json", "json"), ("csv", "csv"), ("xml", "xml"), ("text/plain", "txt")):
        out = F.when(low.contains(part), kind) if out is None else out.when(low.contains(part), kind)
    return out.otherwise("web")


def critical_clauses(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: (x != "") & x.rlike(pattern))


def split_message(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters: cut at a line end, else a space, else hard."""
    out = []
    while len(text) > limit:
        cut = text.rfind("\n", 0, limit + 1)
        cut = cut if cut > 0 else text.rfind(" ", 0, limit + 1)
        cut = cut if cut > 0 else limit
        out.append(text[:cut].rstrip())
        text = text[cut:].lstrip()
    return [*out, text] if text else out


def title_filename(title: Column, most: int = 120) -> Column:
    """Upper case without accents, the word COM left out, other runs as ``_``, cut to ``most``."""
    plain = F.upper(F.translate(F.lower(F.coalesce(title, F.lit(""))), _FOLD_FROM, _FOLD_TO))
    joined = F.regexp_replace(F.regexp_replace(plain, r"\bCOM\b", " "), r"[^A-Z0-9]+", "_")
    return F.left(F.regexp_replace(joined, r"^_+|_+$", ""), F.lit(most))


def table_tokens(value: Column, prefixes: list[str], allowed: list[str]) -> Column:
    """Distinct upper-case names of at least three characters that begin with a prefix, hold ``_`` or
    ``.``, or are allowed, by first occurrence."""
    upper = F.upper(F.translate(F.lower(F.coalesce(value, F.lit(""))), _FOLD_FROM, _FOLD_TO))
    names = F.regexp_extract_all(upper, F.lit(r"[A-Z][A-Z0-9_.]*[A-Z0-9]"), F.lit(0))

    def kept(x: Column) -> Column:
        ok = x.contains("_") | x.contains(".") | x.isin(*allowed)
        for p in prefixes:
            ok = ok | x.startswith(p)
        return ok & (F.length(x) >= 3)

    return F.array_distinct(F.filter(names, kept))


def iso_instant(value: Column) -> Column:
    """An ISO date and time with a zone; null for anything else."""
    zoned = F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))
    return F.when(zoned, value.try_cast("timestamp"))


def normal_scope(scope: Column, keys: list[str]) -> Column:
    """The entries of a map with a known key and a value that is not blank, trimmed."""
    trimmed = F.transform_values(F.map_filter(scope, lambda k, v: k.isin(*keys)), lambda k, v: F.trim(v))
    return F.coalesce(F.map_filter(trimmed, lambda k, v: F.coalesce(v != "", F.lit(False))), F.create_map().cast("map<string,string>"))


def first_filled(value: Column, metadata: Column, key: str) -> Column:
    """A column's text, or where it is null or empty the metadata's entry."""
    return F.coalesce(F.nullif(value, F.lit("")), F.element_at(metadata, key))


def json_fragment(text: Column) -> Column:
    """The JSON in a model's reply, without a code fence: what lies between the first and the last
    square bracket, else brace; the text itself where there is neither."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*|\s*```$", "")
    bare = F.trim(F.when(F.trim(text).startswith("```"), bare).otherwise(F.trim(text)))
    found = lambda pattern: F.nullif(F.regexp_extract(bare, pattern, 0), F.lit(""))
    return F.coalesce(found(r"(?s)\[.*\]"), found(r"(?s)\{.*\}"), bare)
