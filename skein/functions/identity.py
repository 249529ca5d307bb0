"""Ids of nodes and facts, and what can be told from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.vocabulary import ID_PREFIXES


def typed_id(prefix: str, *parts: Column) -> Column:
    """``prefix:part:...``; null if a part is null."""
    return F.concat(F.lit(prefix), *[x for p in parts for x in (F.lit(":"), p)])


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix:sha256 of the parts joined by U+001F, a null as empty text."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.sha2(joined, 256))


def canonical_identity(scheme: str, manager: Column, package: Column, version: Column, node_id: Column) -> Column:
    """``scheme manager package version id``, the id percent-encoded but for ``:._/-``."""
    quoted = F.url_encode(node_id)
    for code, char in (("%3A", ":"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(code), F.lit(char))
    quoted = F.replace(F.replace(F.replace(quoted, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat_ws(" ", F.lit(scheme), manager, package, version, quoted)


def bare_candidates(name: Column) -> Column:
    """The ids a bare name may stand for; only itself where it has a prefix."""
    return F.when(F.contains(name, F.lit(":")), F.array(name)).otherwise(F.array(*[F.concat(F.lit(f"{p}:"), name) for p in ID_PREFIXES]))


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.startswith("tests/") | path.startswith("backend/tests/") | path.contains("/tests/"), F.lit(False))


def module_name(path: Column, source_root: Column) -> Column:
    """Dotted module of a source file below its root; a package's own file is the package."""
    below = F.when(
        path.startswith(F.concat(source_root, F.lit("/"))), F.substring(path, F.length(source_root) + 2, F.length(path))
    ).otherwise(path)
    stem = F.regexp_replace(below, r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/", ".")


def canonical_url_path(path: Column) -> Column:
    """One slash for many, none at the end, ``/`` for nothing."""
    joined = F.regexp_replace(F.coalesce(path, F.lit("")), "/{2,}", "/")
    trimmed = F.regexp_replace(joined, "(?<=.)/$", "")
    return F.when(trimmed == "", "/").otherwise(trimmed)


def normalized_package(name: Column) -> Column:
    """Package names alike whatever separators and case they are spelled with."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


#: (pattern, what is put in its place, whether letter case means nothing): the public forms of credentials, a value
#: that is assigned to a telling name, a login within an address, and the home folder of a path.
DETECTORS = (
    ("-----BEGIN ([A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+-----END ([A-Z]+ )*PRIVATE KEY-----", "[secret]", False),
    ("\\beyJ[\\w-]{6,}[.][\\w-]{6,}[.][\\w-]*", "[secret]", False),
    ("\\b(AKIA|ASIA)[0-9A-Z]{16}\\b", "[secret]", False),
    ("\\b(ghp|gho|ghu|ghs|ghr|github_pat|glpat|xox[abprs]|sk|pk|rk)[-_][\\w-]{16,}", "[secret]", False),
    ("\\b(bearer|basic)[ ]+[\\w.~+/-]{8,}=*", "[secret]", True),
    ("\\b\\w*(passw(or)?d|secret|token|api[_-]?key|credential)\\w*[\"]?[ ]*[:=][ ]*[\"]?[^ \"&,;]{4,}", "[secret]", True),
    ("://[^ /:@]+:[^ /@]+@", "://[secret]@", False),
    ("(/home/|/Users/|[A-Z]:[\\x5c/]Users[\\x5c/])[\\w.-]+", "~", False),
)


def redact(text: Column) -> Column:
    """The text without what looks like a credential or names a person's home folder."""
    for pattern, put, any_case in DETECTORS:
        text = F.regexp_replace(text, ("(?i)" if any_case else "") + pattern, put)
    return text


def like_escaped(term: str) -> str:
    """A term as a LIKE pattern that matches it anywhere and nothing else."""
    for char in ("\\", "%", "_"):
        term = term.replace(char, "\\" + char)
    return f"%{term}%"
