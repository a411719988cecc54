"""Text columns: normal form, word classes, whole-term patterns, tokens, titles."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word character: letter, digit, combining mark, underscore.  Java's own \w is ASCII.
WORD = r"[\p{L}\p{N}\p{M}_]"
SPACE = r"[\s\p{Z}\x85]"
_DASHES = "-" + "".join(map(chr, range(0x2010, 0x2016)))
_EDGES = "".join(sorted("()[]{}.,:;!?'\""))
_NO_SPACES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))


def _nfc(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x) for x in column.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Unicode normal form C.  The JVM has no expression for it, so this is the one text
    helper that needs Arrow; sources apply it once and the operators expect it done."""
    return F.arrow_udf(_nfc, T.StringType())(c)


def normalised(df: DataFrame, *names: str) -> DataFrame:
    """The named string columns in normal form C."""
    return df.withColumns({n: nfc(F.col(n)) for n in names if n in df.columns})


def _spaceless(char: str) -> bool:
    return bool(char) and any(a <= ord(char) <= b for a, b in _NO_SPACES)


def java_quote(text: str) -> str:
    """A regex for the literal text in which any blank stands for white space."""
    return "".join(rf"{SPACE}+" if x == " " else x if x.isalnum() or x == "_" else "\\" + x if x.isascii() and x.isprintable() else x for x in text)


def term_pattern(term: str) -> str:
    """Java regex for ``term`` as a whole word or phrase.  Dashes in the term also match
    a blank; an edge in a script without spaces needs no word boundary."""
    forms = {java_quote(term), java_quote(re.sub(f"[{_DASHES}]+", " ", term))}
    left = "" if _spaceless(term[:1]) else f"(?<!{WORD})"
    right = "" if _spaceless(term[-1:]) else f"(?!{WORD})"
    return f"(?iu){left}(?:{'|'.join(sorted(forms, key=lambda f: (-len(f), f)))}){right}"


def query_terms(query: str) -> list[str]:
    """Quoted phrases whole, other tokens without punctuation at their edges."""
    out = []
    for m in re.finditer(r'"(?P<phrase>[^"]+)"|(?P<word>\S+)', unicodedata.normalize("NFC", query or "")):
        term = (m["phrase"] or m["word"].strip(_EDGES)).strip()
        if term:
            out.append(term)
    return out


def has_term(text: Column, term: str) -> Column:
    return text.rlike(term_pattern(term))


def rank_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, longer than one."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(F.filter(found, lambda t: F.length(t) > 1), F.lower)


def query_tokens(query: str) -> list[str]:
    return [t.lower() for t in re.findall(r"\w+", query or "") if len(t) > 1]


def normalised_title(title: Column) -> Column:
    """Lower case, trimmed, without signs, single blanks."""
    trimmed = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), rf"^{SPACE}+|{SPACE}+$", "")
    plain = F.regexp_replace(trimmed, r"[^\p{L}\p{N}\p{M}_\s\p{Z}\x85]", "")
    return F.regexp_replace(plain, rf"{SPACE}+", " ")


def title_case(c: Column) -> Column:
    """Capital after any character that is not a letter, the rest lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("substring('', 1)"), F.substr(p, F.lit(2)))), "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
