"""What a question asks for: quoted literals, identifiers, and the words that are left."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import values as V


def written_as_code(token: Column) -> Column:
    return (F.length(token) >= V.LEAST_CODE) & token.rlike("|".join(V.CODE_SHAPES))


def question_parts(question: Column) -> Column:
    """``struct(literals, identifiers, words)``; identifiers and words once each, in order, eight and twelve at most.

    What is quoted is a literal, verbatim. The rest is cut at blanks and separators; what is written as code is an
    identifier, what else has four characters or more and says something is a word, in lower case.
    """
    spans = F.regexp_extract_all(question, F.lit(V.QUOTED_SPAN), 0)
    literals = F.transform(spans, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    tokens = F.transform(F.split(F.regexp_replace(question, V.QUOTED_SPAN, " "), V.TOKEN_SEPARATORS), lambda t: F.regexp_replace(t, V.TOKEN_ENDS, ""))
    says = lambda t: ~written_as_code(t) & (F.length(t) >= V.LEAST_WORD) & ~F.lower(t).isin(V.QUESTION_STOP_WORDS) & ~t.rlike("^[0-9]+$")
    return F.struct(
        F.filter(literals, lambda q: F.length(F.trim(q)) >= V.LEAST_LITERAL).alias("literals"),
        F.slice(F.array_distinct(F.filter(tokens, written_as_code)), 1, V.MOST_IDENTIFIERS).alias("identifiers"),
        F.slice(F.array_distinct(F.transform(F.filter(tokens, says), F.lower)), 1, V.MOST_WORDS).alias("words"),
    )


def like_symbol(query: str) -> bool:
    """Whether a query looks like a name in code, so that ranking leans on words: one token with case, ``_`` or a dot inside."""
    return bool(re.fullmatch(r"[A-Za-z_$][\w$.]*", query.strip())) and bool(re.search(r"[a-z][A-Z]|_|\.|^[A-Z]", query.strip()))


def repository_parts(path: Column) -> Column:
    """``struct(owner, repo, ref, rest)`` of ``/owner/repo[.git][@ref][/rest]``; ``-`` where it isn't one."""
    bare = F.regexp_replace(path, r"^(?:[a-z]+://)?(?:[^/]+\.[a-z]+)?/", "")
    owner, second = F.regexp_extract(bare, r"^([\w.-]+)/", 1), F.regexp_extract(bare, r"^[^/]+/([^/?#]+)", 1)
    name = F.regexp_replace(F.regexp_extract(second, r"^([^@]*)", 1), r"\.git$", "")
    ref = F.coalesce(F.nullif(F.regexp_extract(second, r"@(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"^[^/]+/[^/]+/(?:tree|blob)/([^/?#]+)", 1), F.lit("")))
    rest = F.regexp_extract(bare, r"^[^/]+/[^/]+/(?:(?:tree|blob)/[^/]+/?)?([^?#]*)", 1)
    sound = (owner != "") & name.rlike(r"^[\w.-]+$")
    return F.struct(F.when(sound, owner).otherwise("-").alias("owner"), F.when(sound, name).otherwise("-").alias("repo"), ref.alias("ref"), F.when(sound, rest).otherwise("").alias("rest"))


def freshness(kind: Column, age_seconds: Column) -> Column:
    """fresh, stale (served while it is renewed) or expired."""
    out = F.lit("expired")
    for name, (fresh, stale) in V.FRESHNESS.items():
        out = F.when((kind == name) & (age_seconds <= fresh), "fresh").when((kind == name) & (age_seconds <= fresh + stale), "stale").otherwise(out)
    return out


def ingest_state(started_at: Column, finished_at: Column, failed: Column, now: Column) -> Column:
    """not_ingested, ingesting, ready or error; an ingest without an end for three minutes may be tried again."""
    running = F.unix_timestamp(now) - F.unix_timestamp(started_at) <= V.INGEST_STALE_SECONDS
    return F.when(started_at.isNull(), "not_ingested").when(failed, "error").when(finished_at.isNotNull(), "ready").when(running, "ingesting").otherwise("not_ingested")
