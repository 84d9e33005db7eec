"""Text expressions: fingerprints, redaction, phrases, masks. All return Spark SQL text."""

from __future__ import annotations

import re

from sentinel.functions import fixed_values as fv
from sentinel.functions import sql

# Character classes are Unicode aware.
UNICODE = "(?U)"


def _replace(expression: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expression}, {sql.text(UNICODE + pattern)}, {sql.text(replacement)})"


def fingerprint(message: str) -> str:
    """Replace ids, hex runs, quoted strings and digits so that alike messages group together."""
    for pattern, token in fv.FINGERPRINT_STEPS:
        message = _replace(message, pattern, token)
    return f"trim({_replace(message, r'[\s\x1c-\x1f]+', ' ')})"


#: Steps that search longest, and a character without which they find nothing. No step brings it in.
NEEDED = {"email": "@", "ipv6": ":"}


def scrub(expression: str) -> str:
    """Redact secrets and personal data; the order of the steps matters.

    `expression` is a column, as it stands in the result several times.
    """
    done = expression
    for name, pattern, token in fv.REDACTION_STEPS:
        step = _replace(done, pattern, token)
        done = sql.when(f"contains({expression}, {sql.text(NEEDED[name])})", step, done) if name in NEEDED else step
    return done


def secret_flags(expression: str) -> dict[str, str]:
    """Does the raw text contain each kind of secret?"""
    return {name: f"{expression} RLIKE {sql.text(UNICODE + pattern)}"
            for name, pattern, _ in fv.REDACTION_STEPS}


def mask_counters(expression: str) -> str:
    """Hide free-standing numbers; digits that belong to a name or an address stay."""
    return _replace(expression, fv.VOLATILE_NUMBER, "<n>")


def words(expression: str) -> str:
    """Lower-case words, one space around each, ready for `has_phrase`."""
    separators = sql.text(r"[^\p{L}\p{N}_]+")
    return f"concat(' ', regexp_replace(lower({expression}), {separators}, ' '), ' ')"


def has_phrase(words_column: str, phrases: list[str]) -> str:
    """Any of the phrases as consecutive whole words."""
    needles = [" ".join(re.sub(r"[^\w]+", " ", p.lower()).split()) for p in phrases]
    return sql.any_of([f"contains({words_column}, {sql.text(f' {n} ')})" for n in needles])


def contains_any(expression: str, fragments: list[str]) -> str:
    """Case-insensitive substring test; `*` and `?` inside a fragment are wildcards."""
    lowered = list(dict.fromkeys(f.lower() for f in fragments))
    # a fragment that contains a shorter one can never decide anything
    needed = [f for f in lowered if not any(o != f and o in f for o in lowered)]
    wild = {"*": ".*", "?": "."}
    parts = ["".join(wild.get(c) or re.escape(c) for c in f) for f in needed]
    return f"lower({expression}) RLIKE {sql.text('(?s)' + '|'.join(parts))}"


def starts_with_ignoring_case(expression: str, prefix: str) -> str:
    return f"startswith(lower({expression}), {sql.text(prefix.lower())})"
