"""Attributes that follow from a path, a reference or a user agent."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import values as V


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Of the base name; nothing if its only dot is in front."""
    return F.lower(F.regexp_extract(path, r"(?s)[^/]\.([^./]*)$", 1))


def mime(path: Column) -> Column:
    return _lookup(V.MIME, extension(path), "text/plain")


def language(path: Column) -> Column:
    """By what follows the last dot of the whole path."""
    return _lookup(V.LANGUAGES, F.lower(F.regexp_extract(path, r"(?s)^.+\.([^.]*)$", 1)), "text")


def is_docs(path: Column) -> Column:
    return path.rlike(V.DOCS_EXTENSION) | path.rlike(V.DOCS_DIRECTORY)


def is_test(path: Column) -> Column:
    return path.rlike(V.TEST_PATH)


def canonical_docs(path: Column) -> Column:
    """Translations of a page share one path."""
    # fixed value: a language tag
    tag = r"[a-z]{2}(?:[-_][A-Za-z]{2,4})?"
    path = F.regexp_replace(path, rf"^((?:(?!(?:^|/)(?:docs?|documentation)/{tag}/).)*?)(^|/)(docs?|documentation)/{tag}/", "$1$2$3/")
    path = F.regexp_replace(path, rf"\.{tag}\.(md|mdx|rst)$", ".$1")
    return F.regexp_replace(path, r"^(.*?)(^|/)i18n/[^/]+/", "$1$2")


def skip_reason(path: Column, size: Column, max_bytes: int = V.MAX_FILE_BYTES) -> Column:
    """Why ingestion leaves a file out; null if it doesn't."""
    in_dir = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in V.SKIP_DIRS]))
    reason = F.when(in_dir, "skip-dir").when(basename(path).isin(V.SKIP_FILES), "skip-file")
    return reason.when(extension(path).isin(V.BINARY_EXTENSIONS), "skip-binary").when(size > max_bytes, "skip-size")


def ref_kind(ref: Column) -> Column:
    return F.when(ref.isNull() | (ref == ""), "default").when(ref.rlike(r"(?i)^[0-9a-f]{40}$"), "sha").when(ref.rlike(r"^v?[0-9]+\.[0-9]+"), "tag").otherwise("branch")


def client_bucket(agent: Column) -> Column:
    agent_ = F.lower(agent)
    out = F.when(agent.isNull() | (agent == ""), "unknown")
    for name, pattern in V.CLIENTS:
        out = out.when(agent_.rlike(pattern), name)
    out = out.when(agent_.rlike(r"^mozilla/5") & ~agent_.rlike(r"bot|crawler|spider"), "browser")
    return out.when(agent_.rlike(r"bot|crawler|spider|scraper"), "other-bot").otherwise("other")


def path_bucket(path: Column, query: Column) -> Column:
    """Path and query with secrets blanked, cut to 120 characters."""
    whole = F.concat(path, F.regexp_replace(query, r"(?i)([?&])(key|token|secret)=[^&]*", "$1$2=REDACTED"))
    return F.when(F.length(whole) > 120, F.concat(F.substring(whole, 1, 117), F.lit("..."))).otherwise(whole)


def normalized(path: Column) -> Column:
    """Without empty and ``.`` segments; ``..`` takes the segment before it, and nothing above the root."""
    start = F.array().cast("array<string>")
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    return F.array_join(F.aggregate(kept, start, lambda done, s: F.when(s == "..", up(done)).otherwise(F.concat(done, F.array(s)))), "/")


def is_short_sha(ref: Column) -> Column:
    return ref.rlike(r"(?i)^[0-9a-f]{7,39}$")


def is_valid_path(path: Column) -> Column:
    """No empty, ``.`` or ``..`` segments; at most 48 segments, 255 characters in one and 2048 in all."""
    parts = F.split(path, "/", -1)
    sound = F.forall(parts, lambda s: (s != "") & (s != ".") & (s != "..") & (F.length(s) <= 255))
    return sound & (F.size(parts) <= 48) & (F.length(path) <= 2048)
