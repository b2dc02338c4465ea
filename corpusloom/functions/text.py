"""Text functions built from Spark expressions: tokens and identifiers."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a maximal run of letters and digits of any script.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


#: Blocks of Latin letters, as ranges of code points.
LATIN = ((0x00C0, 0x0250), (0x1E00, 0x1F00))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and what each is without them."""
    marked, plain = "", ""
    for low, high in LATIN:
        for c in map(chr, range(low, high)):
            base = unicodedata.normalize("NFD", c)
            if len(base) > 1 and len(base[0]) == 1 and unicodedata.category(base[0])[0] == "L":
                marked, plain = marked + c, plain + base[0]
    return marked, plain


MARKED, PLAIN = _plain_letters()


def folded(text: Column) -> Column:
    """Lower case without the marks of letters, as full-text tokens are compared; texts of ASCII letters alone cost nothing more."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), MARKED, PLAIN)).otherwise(low)


def fold(text: str) -> str:
    """The same of a text on the driver."""
    return "".join(c for c in text.lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(MARKED, PLAIN))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens without marks, in order; null text has none."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), TOKEN_BREAK), "")


def normalized_text(text: Column) -> Column:
    """CRLF and CR become LF, as for content hashes."""
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 hex of the text with normalised line ends."""
    return F.sha2(F.encode(normalized_text(text), "UTF-8"), 256)


def entity_id(namespace: str, *parts: Column) -> Column:
    """A 26-character id of the parts; null parts count as empty, and parts never run together."""
    texts = [F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1f")) for p in parts]
    return F.substring(F.sha2(F.encode(F.concat(F.lit(namespace + "\x1f"), *texts), "UTF-8"), 256), 1, 26)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, whatever the optimizer moves around it."""
    return F.element_at(F.transform(F.array(value), body), 1)
