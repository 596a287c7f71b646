"""Column expressions on text: tokens, comparisons, headers, addresses."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ELLIPSIS = "…"


def _folds() -> tuple[str, str]:
    """Letters that lose their marks: those whose base is a Latin letter; and variants of Greek letters."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and base != c and len(base) == 1 and base in _LOWER and c != "ǡ":
            pairs[c] = base
    pairs |= dict(zip("µſẛςϐϑϕϖϰϱϵ", "μssσβθφπκρε"))
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folds()
TOKEN = r"[\p{L}\p{N}\p{Co}\p{Mn}]+"


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    bare = F.regexp_replace(F.lower(text), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(bare, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """The tokens of a text, in order.

    The text is folded as a whole first: marks neither split tokens nor stay in them, and folding makes letters of
    letters, so the runs are the same and each text passes through a few expressions rather than each token.
    """
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def like_pattern(asked: str) -> str:
    """The pattern of ``LIKE '%asked%'`` for texts in ``ascii_lower``; % and _ in ``asked`` keep their meaning."""
    return "%" + plain_lower(asked).replace("\\", "\\\\") + "%"


def plain_lower(asked: str) -> str:
    return asked.translate(str.maketrans(_UPPER, _LOWER))


def contains_like(text: Column, asked: str) -> Column:
    """``LIKE '%asked%'`` without regard to the case of A-Z."""
    return ascii_lower(text).like(like_pattern(asked))


def equals_nocase(text: Column, asked: str) -> Column:
    return ascii_lower(text) == plain_lower(asked)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends; only texts that have some there are searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def right_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(right_trimmed(F.substring(text, 1, n)), F.lit(ELLIPSIS))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|[\r\n\f\u0085\u2028\u2029]", " ")


def without_header(chunk: Column) -> Column:
    """A chunk's text after its header; a chunk that is only a header has none."""
    gap = F.instr(chunk, "\n\n")
    return F.when(~chunk.startswith("Subject:"), chunk).when(gap > 1, F.substring(chunk, gap + 2, F.length(chunk))).otherwise("")


def address_text(address: Column) -> Column:
    """``Name <address>``, or the address alone where the name says no more."""
    name, place = address["name"], address["address"]
    alone = name.isNull() | (trimmed(name) == "") | (name == place)
    return F.when(alone, place).otherwise(F.concat(name, F.lit(" <"), place, F.lit(">")))


def recipients_text(to: Column, cc: Column) -> Column:
    """Everybody in to, then in cc."""
    kind = "array<struct<name:string,address:string>>"
    every = F.concat(F.coalesce(to, F.array().cast(kind)), F.coalesce(cc, F.array().cast(kind)))
    return F.array_join(F.transform(every, address_text), "; ")


def chunk_header(subject: Column, sender: Column, received: Column) -> Column:
    """``Subject``, ``From`` where there is a sender, ``Date``, and an empty line."""
    line = F.when(sender.isNull(), "").otherwise(F.concat(F.lit("From: "), sender, F.lit("\n")))
    return F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit("")), F.lit("\n"), line, F.lit("Date: "), F.date_format(received, "yyyy-MM-dd"), F.lit("\n\n"))


def passage(subject: Column, text: Column, n: int = 2000) -> Column:
    """What a reranker reads: the subject, if any, and the text, cut at ``n`` characters."""
    return F.substring(F.when(F.coalesce(subject, F.lit("")) != "", F.concat(subject, F.lit("\n"), text)).otherwise(text), 1, n)


def found_by(keyword_rank: Column, vector_rank: Column) -> Column:
    """How a hit was found: ``similar``, ``exact`` or ``both``."""
    return F.when(keyword_rank.isNotNull() & vector_rank.isNotNull(), "both").when(keyword_rank.isNotNull(), "exact").when(vector_rank.isNotNull(), "similar").otherwise("")


def shown_sender(name: Column, address: Column) -> Column:
    blank = lambda c: F.when(trimmed(F.coalesce(c, F.lit(""))) == "", F.lit(None)).otherwise(c)
    return F.coalesce(blank(name), blank(address), F.lit("?"))


def shown_subject(subject: Column) -> Column:
    return F.when(trimmed(F.coalesce(subject, F.lit(""))) == "", "(no subject)").otherwise(subject)


def identifier_like(text: Column) -> Column:
    """``looks_like_identifier`` as an expression."""
    digit, letter = text.rlike(r"\p{Nd}"), text.rlike(r"\p{L}")
    dot = F.instr(text, ".")
    host = (dot > 1) & (dot < F.length(text) - 1) & ~text.endswith(".") & text.rlike(r"^[\p{L}\p{N}.-]+$")
    return (F.length(text) >= 3) & (text.contains("@") | (digit & (letter | (F.length(text) >= 5))) | host)
