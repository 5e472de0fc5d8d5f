"""Privacy and merchant-name expressions, all JVM-side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

# letters and digits of any script, plus underscore
WORD = r"\p{L}\p{N}_"


def any_word(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def mask_handles(text: Column) -> Column:
    """``name@bank`` -> ``nam***@bank`` (short names vanish), at every occurrence.

    Texts without an ``@`` are left alone at once. Handles are first fenced with control characters, so that the second and third
    pass cannot touch text which the first one did not take as a handle.
    """
    h = fv.HANDLE_CHAR
    fenced = F.regexp_replace(text, f"({h}{{2,}}+)(@[a-zA-Z]+)", "\u0001$1\u0002$2")
    long_cut = F.regexp_replace(fenced, f"\u0001({h}{{3}}){h}+\u0002", "$1***")
    masked = F.regexp_replace(long_cut, f"\u0001{h}{{2,3}}\u0002", "***")
    return F.when(text.contains("@"), masked).otherwise(text)


def hash_reference(reference: Column) -> Column:
    return F.when(
        F.length(reference) > 0,
        F.substring(F.sha2(reference, 256), 1, fv.REFERENCE_HASH_LENGTH),
    )


def dedup_key(
    txn_date: Column, amount: Column, direction: Column, name: Column, reference: Column,
    name_length: int | None = None,
) -> Column:
    """Content key of a row: by reference where there is one, else by day and whole name.

    ``name_length`` keys by that many letters of the name only, which merges rows whose
    names differ later on.
    """
    short = F.substring(name, 1, name_length) if name_length else name
    money = amount.cast("decimal(14,2)").cast("string")
    by_reference = F.concat_ws("|", F.concat(F.lit("ref:"), reference), direction, money)
    by_name = F.concat_ws(
        "|",
        F.date_format(txn_date, "yyyy-MM-dd"),
        money,
        direction,
        F.lower(short),
    )
    text = F.when(F.length(reference) > 0, by_reference).otherwise(by_name)
    return F.substring(F.sha2(text, 256), 1, fv.DEDUP_KEY_LENGTH)


def scrub_merchant(name: Column, mask_first: bool = True) -> Column:
    """Reduce a counterparty text to an upper-case merchant name.

    ``mask_first`` hides handles before their bank suffix is dropped, so a merchant
    known only by its handle keeps three letters. Names of ASCII characters without a handle
    and any noise word, as most are, take fewer and plainer patterns to the same end.
    """
    low = F.lower(name)
    plain = ((F.octet_length(name) == F.length(name)) & ~name.contains("@")
             & ~reduce(or_, [low.contains(w) for w in fv.NOISE_WORDS]))
    p = F.regexp_replace(name, rf"(?i)^\s*{any_word(fv.TXN_PHRASES)}\s+", "")
    p = F.regexp_replace(p, r"[\s\-_]*\d{4,}$", "")
    p = F.upper(F.trim(F.regexp_replace(p, "[^A-Za-z0-9_&]+", " ")))
    n = mask_handles(name) if mask_first else name
    n = F.regexp_replace(n, rf"(?iU)^\s*{any_word(fv.TXN_PHRASES)}\s+", "")
    n = F.regexp_replace(n, r"@[a-zA-Z]+", "")
    n = F.regexp_replace(n, r"(?U)[\s\-_]*\d{4,}$", "")
    n = F.regexp_replace(n, rf"(?iu)(?<![{WORD}]){any_word(fv.NOISE_WORDS)}(?![{WORD}])", "")
    n = F.regexp_replace(n, rf"(?U)[^{WORD}\s&]", " ")
    n = F.upper(F.trim(F.regexp_replace(n, r"(?U)\s+", " ")))
    n = F.when(plain, p).otherwise(n)
    return F.coalesce(F.nullif(n, F.lit("")), F.lit(fv.UNKNOWN))


def text_counterparty(text: Column, length: int | None = None) -> Column:
    """What is left of a statement line without its date, time, amount and verbs.

    ``length`` cuts it for display.
    """
    t = F.regexp_replace(text, f"(?mdU)^{fv.TEXT_DATE}", "")
    t = F.regexp_replace(t, f"(?U){fv.TEXT_TIME}", "")
    t = F.regexp_replace(t, f"(?U){fv.TEXT_AMOUNT}", "")
    words = any_word(fv.TEXT_DROP_WORDS)
    t = F.regexp_replace(t, rf"(?iu)(?<![{WORD}]){words}(?![{WORD}])", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"^[ \-|,]+|[ \-|,]+$", "")
    t = F.substring(t, 1, length) if length else t
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fv.UNKNOWN))
