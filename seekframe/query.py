"""The search language: words, "phrases" and filters.  Runs on the driver; a query is a few words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

# The function words of nine languages that are not searched for if anything else is.
STOPWORDS = frozenset(
    """
    a an the and or of to in on at for is are was were be it this that with from by as we i you he she they my our your
    when what where who how do does did can will
    och att det är en ett som på av för med till den de om var när vad vem hur jag du vi ni har kan ska inte så nästa
    från eller min vår er
    og er af jeg ikke hvad hvornår når hva fra til dette denne
    der die das und ist ich wir sie nicht mit für auf von zu wann wie wo was ein eine oder
    het een van niet wat wanneer hoe wij ik je met voor naar
    le la les et est un une des du pour avec que qui quand où comment nous vous pas ou
    el los las y es por con para cuándo cómo dónde yo no o
    ja ei se että kun mitä milloin miten minä me tai
    """.split()
)


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    sender: str | None = None
    to: str | None = None
    after: datetime | None = None
    before: datetime | None = None
    has_attachments: bool | None = None
    folder: str | None = None

    @property
    def has_filters(self) -> bool:
        return any(x is not None for x in (self.sender, self.to, self.after, self.before, self.has_attachments, self.folder))

    @property
    def has_text(self) -> bool:
        return bool(self.terms or self.phrases)

    @property
    def semantic_text(self) -> str:
        return " ".join([*self.phrases, *self.terms])

    @property
    def parts(self) -> list[str]:
        """What is matched, each as a phrase: phrases, and words that aren't stopwords (all words if nothing else is left)."""
        words = [t for t in self.terms if t.casefold() not in STOPWORDS]
        if not words and not self.phrases:
            words = self.terms
        return [p for p in (x.replace('"', "") for x in [*self.phrases, *words]) if p]

    def match_text(self, any_part: bool = False) -> str:
        return (" OR " if any_part else " AND ").join(f'"{p}"' for p in self.parts)

    @property
    def asks_for_identifier(self) -> bool:
        return any(map(looks_like_identifier, self.phrases))


def period(value: str) -> tuple[datetime, datetime] | None:
    """The half-open period that ``yyyy``, ``yyyy-mm`` or ``yyyy-mm-dd`` names, in UTC."""
    if not re.fullmatch(r"[0-9]{4}(-[0-9]{2}){0,2}", value):
        return None
    y, m, d = (int(x) for x in (value.split("-") + ["0", "0"])[:3])
    try:
        start = datetime(y, m or 1, d or 1, tzinfo=timezone.utc)
        if value.count("-") == 2:
            return start, datetime.fromtimestamp(start.timestamp() + 86400, timezone.utc)
        return start, datetime(y + (m in (0, 12)), m % 12 + 1 if m else 1, 1, tzinfo=timezone.utc)
    except ValueError:
        return None


def _split(text: str) -> list[tuple[str, bool]]:
    """Words, and whether each began with a quotation mark.  Blanks between marks belong to the word."""
    out, word, inside, quoted = [], "", False, False
    for c in text:
        if c == '"':
            quoted = quoted or (not word and not inside)
            inside = not inside
        elif c.isspace() and not inside:
            if word:
                out.append((word, quoted))
                word, quoted = "", False
        else:
            word += c
    return out + ([(word, quoted)] if word else [])


def _as_filter(key: str, value: str) -> dict | None:
    """Fields that ``key:value`` sets; None if it is no filter."""
    match key:
        case "from":
            return {"sender": value}
        case "to":
            return {"to": value}
        case "folder" | "in":
            return {"folder": value}
        case "has":
            return {"has_attachments": True} if value.lower().startswith("attach") else None
        case "after" | "since" | "before" | "until":
            found = period(value)
            return found and {"after" if key in ("after", "since") else "before": found[0]}
    return None


def parse(text: str) -> Query:
    out = Query()
    for word, quoted in _split(text):
        key, colon, value = word.partition(":")
        fields = _as_filter(key.lower(), value) if colon and key and value and not quoted else None
        if fields:
            for name, given in fields.items():
                setattr(out, name, given)
        else:
            (out.phrases if quoted else out.terms).append(word)
    return out


def looks_like_identifier(text: str) -> bool:
    """Order numbers, ticket ids, addresses and host names."""
    if len(text) < 3:
        return False
    digit, letter = any(c.isdecimal() for c in text), any(c.isalpha() for c in text)
    if "@" in text or (digit and (letter or len(text) >= 5)):
        return True
    dot = text.find(".")
    return 0 < dot < len(text) - 2 and text[-1] != "." and all(c.isalnum() or c in ".-" for c in text)
