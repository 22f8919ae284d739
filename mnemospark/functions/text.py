"""Text functions as native column expressions. Caps count characters, budgets count UTF-8 bytes."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STOP_WORDS


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """From Unicode's own rules: single characters that fold to one plain character, and those to several."""
    one_from, one_to, many = [], [], []
    for code in range(0xA0, min(sys.maxunicode, 0x2100)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if plain == c.lower() or unicodedata.combining(c):
            continue
        if len(plain) == 1:
            one_from.append(c)
            one_to.append(plain)
        elif plain and unicodedata.category(c).startswith("L") and code < 0x180:
            many.append((c, plain))
    return "".join(one_from), "".join(one_to), many


FOLD_FROM, FOLD_TO, FOLD_MANY = _fold_table()


def fold(x: Column) -> Column:
    """Case and accents removed: exact for Latin, Greek and Cyrillic letters; see python_text.fold for all of Unicode."""
    raw, x = x, F.lower(x)
    for c, plain in FOLD_MANY:
        if c == c.lower():
            x = F.replace(x, F.lit(c), F.lit(plain))
    x = F.regexp_replace(F.translate(x, FOLD_FROM, FOLD_TO), r"\p{M}+", "")  # each step once: a test before it would run all before that again
    return F.when(F.octet_length(raw) == F.length(raw), F.lower(raw)).otherwise(x)  # ASCII has nothing else to fold


def tokens(x: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Search words in order, with repeats: folded, of two characters or more, no stop words."""
    return folded_tokens(fold(x), stop_words)


def folded_tokens(x: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """The same of a text that is folded already."""
    words = F.transform(F.regexp_extract_all(x, F.lit(r"(?U)([\w.-]+)"), F.lit(1)), lambda w: F.btrim(w, F.lit(".-")))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(stop_words)))


def code_words(x: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """The distinct search words of x and their dotted parts."""
    t = tokens(x, stop_words)
    return F.array_union(t, F.flatten(F.transform(t, lambda w: F.split(w, r"\."))))


def lines(x: Column) -> Column:
    """Lines without their ends; no empty one after a final line break."""
    parts = F.split(x, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def hit_id(source: Column, line: Column, revision: Column) -> Column:
    return F.substring(digest(F.concat_ws(":", source, line.cast("string"), revision)), 1, 24)


def squeeze(x: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fingerprint(x: Column) -> Column:
    return F.substring(digest(squeeze(x)), 1, 16)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


# What counts as a secret, in this order, and what replaces it.
# Every repeated group is possessive: what follows one can never begin inside it, and Java then needs no stack.
_VALUE = r"""(?:"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|%s)"""
REDACTIONS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"\b(?:glpat-|gh[pousr]_|sk-|(?:sk|pk|rk)_(?:live|test)_|npm_|xox[baprs]-)[A-Za-z0-9_.-]{8,}", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"(://[^/\s:@]+):[^/\s]+@", "$1:[REDACTED]@"),
    (r"(?i)\bBearer\s+\S+", "Bearer [REDACTED]"),
    (r"(?i)(Authorization\s*:\s*Basic\s+)\S+", "$1[REDACTED]"),
    (r"""(?i)(?<![A-Za-z])((?:PASSWD|PWD)(?:[_-][A-Za-z0-9]++)*+["']?\s*[=:]\s*)""" + _VALUE % r"[^\s;]+", "$1[REDACTED]"),
    (r"""(?<![A-Za-z])((?:PASS|CREDENTIALS?)(?:[_-][A-Za-z0-9]++)*+["']?\s*[=:]\s*)""" + _VALUE % r"\S+", "$1[REDACTED]"),
    (r"""(?i)((?:TOKEN|SECRET|PASSWORD|SENHA|SEGREDO|API_KEY|APIKEY)(?:[_-][A-Za-z0-9]++)*+["']?\s*[=:]\s*)""" + _VALUE % r"\S+", "$1[REDACTED]"),
)


# A text without any of these strings (the second list: in any case) has nothing that REDACTIONS match.
_HINTS = "PRIVATE KEY-----|glpat-|ghp_|gho_|ghu_|ghs_|ghr_|sk-|k_live_|k_test_|npm_|xox|eyJ|AKIA|PASS|CREDENTIAL".split("|")
_HINTS_ANY_CASE = "bearer authorization passwd pwd token secret password senha segredo api_key apikey".split()


def may_have_secret(x: Column) -> Column:
    """A cheap test that is true wherever redact changes anything."""
    low = F.lower(x)
    hints = [F.contains(x, F.lit(h)) for h in _HINTS] + [F.contains(low, F.lit(h)) for h in _HINTS_ANY_CASE]
    found = F.contains(x, F.lit("://")) & F.contains(x, F.lit("@"))
    for h in hints:
        found = found | h
    return found


def redact(x: Column) -> Column:
    """x without secrets; texts that can hold none pass without a pattern."""
    y = x
    for pattern, plain in REDACTIONS:
        y = F.regexp_replace(y, pattern, plain)
    return F.when(may_have_secret(x), y).otherwise(x)


def has_secret(x: Column) -> Column:
    return redact(x) != x


def slug(x: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def encode_path(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9-]", "-")


def normalize_url(x: Column) -> Column:
    """host/path in lower case: no scheme, user, port, trailing slashes or .git; empty if it is none."""
    u = F.regexp_replace(F.regexp_replace(F.trim(x), "/+$", ""), r"\.git$", "")
    web, ssh = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+)$", r"^(?:[^@/]+@)?([^:/]+):(?!//)(.+)$"
    part = lambda p: F.concat_ws("/", F.regexp_extract(u, p, 1), F.regexp_replace(F.regexp_extract(u, p, 2), "^/+", ""))
    return F.lower(F.when(u.rlike(web), part(web)).when(u.rlike(ssh), part(ssh)).otherwise(""))


def clip(x: Column, most: int) -> Column:
    """At most so many characters, then no more than one empty line in a row."""
    return F.regexp_replace(F.substring(x, 1, most), "\n{3,}", "\n\n")


def frontmatter_field(x: Column, name: str) -> Column:
    """A field of the first ``---`` block, null without one."""
    block = F.regexp_extract(x, r"(?s)\A---\n(.*?)\n---", 1)
    value = F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.when(value != "", value)


def links(x: Column) -> Column:
    """Relative targets of Markdown links, as written; code, URLs, anchors and absolute paths are none."""
    plain = F.regexp_replace(x, r"`[^`\n]*`", "")
    return F.regexp_extract_all(plain, F.lit(r"\]\((?![A-Za-z][A-Za-z0-9+.-]*:|[/~#<$\\])([^)\s#]+)"), F.lit(1))


def wikilinks(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def parse_cap(x: Column, default: int = 2500) -> Column:
    """A cap file's whole content as one integer of 1 to 999999999, or the default."""
    whole = F.regexp_replace(x, r"[\r\n]+$", "")
    n = F.try_to_number(F.when(whole.rlike(r"\A[0-9]{1,9}\z"), whole), F.lit("999999999")).cast("int")
    return F.when(n > 0, n).otherwise(default)


def newest_date(x: Column, today: Column) -> Column:
    """The newest ISO date in a text that is not after today."""
    days = F.transform(F.regexp_extract_all(x, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return F.array_max(F.filter(days, lambda d: d <= today))


def item_id(kind: Column, target: Column, what: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", kind, target, what)), 1, 8)


def unfence(x: Column) -> Column:
    """A model's JSON answer without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(x, r"\A\s*(?:```(?:json)?)?\s*", ""), r"\s*(?:```)?\s*\z", "")


def quote_form(x: Column) -> Column:
    """What formatting does not change: no marks, plain dashes, arrows and quotes, one blank, one case."""
    x = F.regexp_replace(x, "[*`]+", "")
    for glyph, plain in (("→", "->"), ("—", "-"), ("–", "-"), ("“", '"'), ("”", '"'), ("’", "'")):
        x = F.replace(x, F.lit(glyph), F.lit(plain))
    return F.lower(squeeze(x))


def quote_supported(quote: Column, source: Column) -> Column:
    """Every part of a quote between ellipses is in the source, in order; each has 12 characters or more."""
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), quote_form), lambda s: s != "")
    hay = quote_form(source)

    def step(at, s):
        found = F.call_function("locate", s, hay, at)
        return F.when((at > 0) & (found > 0), found + F.length(s)).otherwise(0)

    return (F.size(parts) > 0) & F.forall(parts, lambda s: F.length(s) >= 12) & (F.aggregate(parts, F.lit(1), step) > 0)
