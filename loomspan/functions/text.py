"""Text patterns and functions shared by operators."""

#: One or more blanks of any kind, for Java regular expressions.
BLANK = r"[\s   -​    　﻿]+"

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token: letters and digits, with apostrophes or hyphens inside; accents may be stored apart.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:['’-][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*"


def _folding() -> dict[str, str]:
    """Single characters that the token normaliser maps to single characters, worked out from Unicode.

    Case-folded, compatibility-decomposed, accents dropped where the base is Latin.
    """
    table = {}
    for cp in [*range(0xAA, 0x3400), *range(0xF900, 0xFFE0)]:
        c = chr(cp)
        if not c.isalnum():
            continue
        folded = normalise_token_text(c)
        if folded != c and len(folded) == 1 and c != c.lower() or folded != c.lower() and len(folded) == 1 and len(c.lower()) == 1:
            table[c.lower() if len(c.lower()) == 1 else c] = folded
    return {k: v for k, v in table.items() if k != v}


def normalise_token_text(value: str) -> str:
    """The exact rule: casefold, NFKD, drop accents after Latin letters, NFKC, straight apostrophe."""
    out, latin = [], False
    for c in unicodedata.normalize("NFKD", value.casefold()):
        if unicodedata.combining(c):
            if latin:
                continue
        else:
            latin = "LATIN" in unicodedata.name(c, "")
        out.append(c)
    return unicodedata.normalize("NFKC", "".join(out)).replace("’", "'")


_TABLE = _folding()
FOLD_FROM, FOLD_TO = "".join(_TABLE), "".join(_TABLE.values())


def tokens(text: Column) -> Column:
    """The tokens of a text in order, as they are written."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def normalised(token: Column) -> Column:
    """The concept key of a token, on the JVM: equal to :func:`normalise_token_text` but for ligatures of several letters."""
    lowered = F.translate(F.lower(token), FOLD_FROM + "’", FOLD_TO + "'")
    return F.regexp_replace(F.replace(lowered, F.lit("ß"), F.lit("ss")), r"([a-z])\p{M}+", "$1")


def concept_keys(text: Column) -> Column:
    """Normalised tokens of a text.  Null text gives null, a text without tokens an empty array."""
    return tokens(normalised(text))


def token_list(text: str) -> list[str]:
    """The normalised tokens of one text, as :func:`concept_keys` gives them."""
    import regex

    return regex.findall(TOKEN, normalise_token_text(text))


@F.arrow_udf(T.StringType())
def _nfkc(batch: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in batch.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc_folded(batch: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in batch.to_pylist()], pa.string())


def compatible(text: Column, fold: bool = False) -> Column:
    """The NFKC form of a text, case-folded if asked for; ASCII texts stay on the JVM."""
    ascii_only = text.rlike(r"\A\p{ASCII}*\z")
    return F.when(ascii_only, F.lower(text) if fold else text).otherwise((_nfkc_folded if fold else _nfkc)(F.when(~ascii_only, text)))


@F.udf(T.StringType(), useArrow=True)
def normalise_token(value):
    """The exact token rule as a UDF, for text with ligatures."""
    return None if value is None else normalise_token_text(value)


#: The same expressions for the SQL oracles: {0} is the text.
SQL_NORMALISED = "regexp_replace(replace(translate(lower({0}), '" + FOLD_FROM + "’', '" + FOLD_TO + "'''), 'ß', 'ss'), '([a-z])\\p{{M}}+', '\\1', 'g')"
SQL_TOKENS = "regexp_extract_all(" + SQL_NORMALISED + ", '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*(?:[''’-][\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*)*')"


def clean(text: Column) -> Column:
    """Runs of white space as one blank, none around."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ellipsis(text: Column, most: int) -> Column:
    """At most ``most`` characters; a longer text ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def slug(text: Column, fallback: str) -> Column:
    """Lower-case ASCII words joined by hyphens; long ones end in a digest, empty ones become the fallback's."""
    lowered = F.translate(F.lower(text), FOLD_FROM, FOLD_TO)
    base = F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    digest = F.substring(F.sha2(text, 256), 1, 8)
    return F.when(base == "", F.concat(F.lit(f"{fallback}-"), digest)).when(F.length(base) > 48, F.concat(F.regexp_replace(F.substring(base, 1, 39), r"-+$", ""), F.lit("-"), digest)).otherwise(base)


def hashed_id(prefix: str, text: Column, length: int) -> Column:
    """A deterministic id: prefix and the first hexadecimal digits of the SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def hash_number(text: Column, modulus: int) -> Column:
    """The first eight bytes of the SHA-256 as an unsigned number, modulo ``modulus``."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(modulus)).cast("long")


def json_entries(value: Column) -> Column:
    """The members of a JSON object as map<string,string> of name to canonical JSON; empty for anything else."""
    members = F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>")
    return F.coalesce(F.transform_values(members, lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))), F.create_map().cast("map<string,string>"))


def canonical_value(value) -> str:
    """A value as the JSON that :func:`json_entries` gives for it."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_json(value: str | None) -> str | None:
    """Sorted, compact JSON of a JSON text; null if it isn't well formed or has repeated names."""

    def pairs(items):
        found = dict(items)
        if len(found) != len(items):
            raise ValueError("repeated name")
        return found

    def refuse(name):
        raise ValueError(name)

    if value is None:
        return None
    try:
        return json.dumps(json.loads(value.removeprefix("﻿"), object_pairs_hook=pairs, parse_constant=refuse), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.udf(T.StringType(), useArrow=True)
def context_json(value):
    """:func:`canonical_json` of a JSON object; null for anything else."""
    shape = canonical_json(value)
    return shape if shape is not None and shape.startswith("{") else None


@F.udf(T.StringType(), useArrow=True)
def context_signature(value):
    """SHA-256 of the canonical JSON of a context; ``global`` for an empty object, null for no JSON."""
    shape = canonical_json(value)
    return None if shape is None else "global" if shape == "{}" else hashlib.sha256(shape.encode("utf-8", "surrogatepass")).hexdigest()


def single_json_object(text: str | None) -> str | None:
    """The one JSON object in a model's answer, with or without a code fence; null if there is none or more than one."""
    if text is None:
        return None
    found, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
            continue
        if c == '"' and depth:
            quoted = True
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found[0] if len(found) == 1 and canonical_json(found[0]) is not None else None


json_object = F.udf(single_json_object, T.StringType(), useArrow=True)


def repaired(text: str | None, evidence: list[str] | None) -> str | None:
    """Words with U+FFFD replaced by the one evidence word that fits; others stay."""
    if text is None or "�" not in text:
        return text
    words = {w for e in evidence or () if e for w in re.findall(r"[^\W_]+", e)}

    def fix(m: re.Match) -> str:
        shape = re.compile(".".join(map(re.escape, m[0].split("�"))) + r"\Z", re.S)
        fits = [w for w in words if shape.match(w)]
        return fits[0] if len(fits) == 1 else m[0]

    return re.sub(r"[^\W_]*�[^\W_�]*(?:�[^\W_]*)*", fix, text)


repair_words = F.udf(repaired, T.StringType(), useArrow=True)
