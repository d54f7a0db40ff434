"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Personal-data patterns in the order in which they are applied.
PII = [
    ("[PII_EMAIL]", r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("[PII_SSN]", r"\b(?!000|666|9\d{2})\d{3}[- ](?!00)\d{2}[- ](?!0{4})\d{4}\b"),
    ("[PII_CC]", r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})\b"),
    ("[PII_PHONE]", r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"),
    ("[PII_IP]", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("[PII_NI]", r"(?i)\b[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}\d{6}[A-D]\b"),
]
#: Names of secrets, characters of a value, and the patterns of summaries in order, with replacements.
_SECRET_KEY = r"api[_-]?key|(?:access[_-]?|auth[_-]?)?token|password|secret"
_SECRET_CHAR = r"[^\s,;}\]\"')]"
SECRETS = [
    (r"(?i)Bearer\s+\S+", "Bearer [REDACTED]"),
    (r"(?i)-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----", "[PRIVATE KEY REDACTED]"),
    (rf'(?i)("(?:{_SECRET_KEY})"\s*:\s*"?){_SECRET_CHAR}+', "$1[REDACTED]"),
    (rf"(?i)((?:^|\b|[_-])(?:{_SECRET_KEY})\s*[=:]\s*[\"']?){_SECRET_CHAR}+", "$1[REDACTED]"),
    (r"\bsk-(?:ant-)?[a-zA-Z0-9_-]{5,}\b", "[API KEY REDACTED]"),
]


def tokens(text: Column) -> Column:
    """Lower-case Unicode word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, limit: int = 220) -> Column:
    """White space collapsed; longer texts end in ``...``."""
    t = collapse(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def redact(text: Column, patterns: list[tuple[str, str]] = PII) -> tuple[Column, Column]:
    """The text with each pattern's hits replaced in turn, and the number of hits."""
    hits = F.lit(0)
    for label, pattern in patterns:
        hits = hits + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, label.replace("$", r"\$"))
    return text, hits.cast("long")


def secret_summary(text: Column, limit: int = 80) -> tuple[Column, Column]:
    hits = F.lit(0)
    for pattern, replacement in SECRETS:
        hits = hits + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, replacement)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text), hits.cast("long")


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", F.lit("na")).otherwise(s)


def canonical_name(name: Column) -> Column:
    """Camel case split, lower case, marks to blanks."""
    spaced = F.regexp_replace(F.trim(name), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(spaced), r"[^a-z0-9 ]+", " "), r" +", " "))


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def principals(values: Column) -> Column:
    """Trimmed, lower-cased, blank ones dropped, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


#: Keys that no audit payload shows, words of a credential, aliases of predicates.
_FORBIDDEN = ["answer_prompt", "chunk_text", "extracted_text", "full_prompt", "messages", "password", "prompt", "raw_prompt", "raw_secret", "secret", "text", "token"]
_CREDENTIAL = ["secret", "password", "token", "credential"]
_PREDICATES = {"depends": "depends_on", "dependency": "depends_on", "reference": "references", "routes": "routes_to", "assigned": "assigned_to", "conflicts": "conflicts_with"}


def clip_payload(payload: Column, limit: int = 240) -> Column:
    """A string map with forbidden keys redacted and long values clipped."""
    short = lambda v: F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit - 3), F.lit("..."))).otherwise(v)
    return F.transform_values(payload, lambda k, v: F.when(F.lower(k).isin(_FORBIDDEN), F.lit("[REDACTED]")).otherwise(short(v)))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "_")


def credential(value: Column) -> Column:
    """Names a credential and looks like one: an address, an assignment or a long string."""
    v = F.lower(value)
    named = F.lit(False)
    for word in _CREDENTIAL:
        named = named | v.contains(word)
    return named & (v.contains("://") | v.contains("=") | (F.length(value) > 80))


def predicate(name: Column) -> Column:
    """Lower case with underscores, aliases resolved."""
    normal = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    known = F.create_map(*(F.lit(x) for pair in _PREDICATES.items() for x in pair))
    return F.substring(F.coalesce(known[normal], F.when(normal != "", normal), F.lit("related_to")), 1, 128)
