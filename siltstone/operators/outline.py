"""Symbols of source files, from patterns on lines and running bracket depth; all native expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from siltstone.functions.lexer import blanked
from siltstone.functions.paths import language
from siltstone.functions.text import lines

MAX_SIGNATURE = 200


@dataclass(frozen=True)
class Form:
    """A line that begins a symbol; the pattern's only group is its name. Spans end by braces, indentation, or not at all."""

    languages: tuple[str, ...]
    kind: str
    pattern: str
    span: str = "braces"


_JS, _C = ("typescript", "javascript", "vue", "svelte"), ("c", "cpp", "objc", "java", "kotlin", "csharp", "scala")
_MODIFIERS = r"(?:public|private|protected|internal|static|final|abstract|sealed|open|data|override|async|virtual|inline|extern|const|unsigned)"
FORMS = [
    Form(_JS, "function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    Form(_JS, "class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    Form(_JS, "interface", r"^export\s+(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    Form(_JS, "type", r"^export\s+(?:declare\s+)?type\s+([A-Za-z_$][\w$]*)", "none"),
    Form(_JS, "enum", r"^export\s+(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    Form(_JS, "const", r"^export\s+(?:const|let|var)\s+(?!enum\b)([A-Za-z_$][\w$]*)", "none"),
    Form(("python",), "function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)", "indent"),
    Form(("python",), "class", r"^class\s+([A-Za-z_]\w*)", "indent"),
    Form(("go",), "function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    Form(("go",), "class", r"^type\s+([A-Za-z_]\w*)\s+struct\b"),
    Form(("go",), "interface", r"^type\s+([A-Za-z_]\w*)\s+interface\b"),
    Form(("rust",), "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)"),
    Form(("rust",), "class", r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)", "none"),
    Form(("rust",), "interface", r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_]\w*)"),
    Form(("rust",), "enum", r"^(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)", "none"),
    Form(_C, "class", rf"^\s*(?:{_MODIFIERS}\s+)*(?:class|interface|object|trait|record)\s+([A-Za-z_]\w*)"),
    Form(_C, "struct", r"^(?:typedef\s+)?struct\s+([A-Za-z_]\w*)"),
    Form(_C, "enum", r"^(?:typedef\s+)?enum\s+(?:class\s+)?([A-Za-z_]\w*)"),
    Form(_C, "define", r"^\s*#\s*define\s+([A-Za-z_]\w*)", "none"),
    Form(_C, "function", rf"^(?:{_MODIFIERS}\s+)*(?:fun\s+|def\s+|[A-Za-z_][\w:<>,\[\]]*[\s*&]+)(?!(?:if|for|while|switch|return|else|new|throw|case)\b)([A-Za-z_]\w*)\s*\([^;=]*$"),
    Form(("swift",), "function", r"^\s*(?:(?:public|private|internal|open|static|final|override)\s+)*func\s+([A-Za-z_]\w*)"),
    Form(("swift",), "class", r"^\s*(?:(?:public|private|internal|open|final)\s+)*(?:class|struct|actor|extension)\s+([A-Za-z_]\w*)"),
    Form(("swift",), "interface", r"^\s*(?:(?:public|private|internal)\s+)*protocol\s+([A-Za-z_]\w*)"),
]
IMPORTS = [
    (_JS, r"""^\s*(?:import|export)\b.*?from\s+['"]([^'"]+)['"]|^\s*import\s+['"]([^'"]+)['"]"""),
    (("python",), r"^(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))"),
    (("go",), r"""^(?:import\s+(?:\w+\s+)?"([^"]+)"|\s+(?:\w+\s+)?"([^"]+)"\s*$)"""),
    (("rust",), r"^\s*(?:pub\s+)?use\s+([^;{]+)|^()$"),
    (_C, r"^\s*#\s*include\s+[<\"]([^>\"]+)|^\s*(?:import|using)\s+([\w.*]+)"),
    (("swift",), r"^import\s+(\w+)|^()$"),
]


#: What isn't code: comments of several lines and of one, strings that may go on over lines and those that may not.
_NOT_CODE = r"""/\*(?s:.*?)\*/|//[^\n]*|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*+`"""
#: Signs of what one pattern can't tell: triple quotes, code in templates, pattern literals, lifetimes.
_HARD = r""""{3}|'{3}|\$\{|(?:[=(,:;!&|?{}\[+]|\b(?:return|case|typeof))[ \t]*/[^/*\n]|&'|<'"""


def bare(text: Column) -> Column:
    """The text with comments and strings blanked, and all its line feeds."""
    gaps, found = F.split(text, _NOT_CODE, -1), F.regexp_extract_all(text, F.lit(_NOT_CODE), 0)
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.regexp_replace(m, r"[^\n]", ""), F.lit("")))), "")


@F.pandas_udf(StringType())
def _lexed(text: pd.Series, language_: pd.Series) -> pd.Series:
    return pd.Series([blanked(t, k) if t is not None else None for t, k in zip(text, language_, strict=True)], dtype=object)


def code_of(text: Column, language_: Column) -> Column:
    """``bare()`` of plain texts; only those with constructs that a pattern can't tell go through the lexer."""
    return F.coalesce(_lexed(F.when(text.rlike(_HARD), text), language_), bare(text))


def code_lines(files: DataFrame) -> DataFrame:
    """``(path, language, line, text, code)``: lines from 1, and each without strings and comments, also those that go on over lines."""
    own = files.select("path", "text", language(F.col("path")).alias("language")).withColumn("_code", code_of(F.col("text"), F.col("language")))
    both = F.arrays_zip(lines(F.col("text")).alias("text"), lines(F.col("_code")).alias("code"))
    each = own.select("path", "language", F.posexplode(both).alias("pos", "l"))
    return each.where(F.col("l")["text"].isNotNull()).select("path", "language", (F.col("pos") + 1).alias("line"), F.col("l")["text"].alias("text"), F.coalesce(F.col("l")["code"], F.lit("")).alias("code"))


def _first(pattern: str, text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _measured(files: DataFrame) -> DataFrame:
    """Lines with the symbol that each begins, its depth before and after, and its indentation."""
    form = F.lit(None)
    for f in reversed(FORMS):
        found = _first(f.pattern, F.col("text"))
        form = F.when(F.col("language").isin(*f.languages) & found.isNotNull(), F.struct(F.lit(f.kind).alias("kind"), found.alias("name"), F.lit(f.span).alias("span"))).otherwise(form)
    all_ = code_lines(files).withColumn("_form", form).select("*", "_form.*").drop("_form")
    count = lambda c: F.length("code") - F.length(F.replace("code", F.lit(c), F.lit("")))
    rows = all_.withColumns({"open": count("{"), "step": count("{") - count("}"), "indent": F.length(F.regexp_extract("text", r"^[ \t]*", 0)), "blank": F.trim("text") == ""})
    after = F.sum("step").over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("after", after).withColumn("before", F.col("after") - F.col("step"))


def _spans(rows: DataFrame) -> DataFrame:
    """The ``rows`` that have a name, without their code, with ``end_line`` for those that have a ``span``; a window over the lines of a file and, at each level, over what
    begins and ends there, so the work is in proportion to the lines.

    Braces end on the first line from the one that opens them on which the depth is back. Indentation ends on the
    last line that isn't blank before one that is as little indented.
    """
    file, back = Window.partitionBy("path").orderBy("line"), Window.partitionBy("path").orderBy(F.desc("line"))
    solid = rows.withColumns({"opened": F.min(F.when(F.col("open") > 0, F.col("line"))).over(back), "_solid": F.when(~F.col("blank"), F.struct("line", "indent"))})
    solid = solid.withColumns({"_prior": F.last("_solid", True).over(file.rowsBetween(Window.unboundedPreceding, -1)), "_end": F.max(F.when(~F.col("blank"), F.col("line"))).over(Window.partitionBy("path"))})
    braces, indents = F.col("span") == "braces", F.col("span") == "indent"
    level = F.when(braces, F.col("before")).otherwise(F.col("indent")).cast("int")
    at = F.when(braces, F.col("opened")).when(indents, F.col("line") + 1)
    columns = [c for c in rows.columns if c not in ("path", "code")]
    symbol = F.struct(*columns)
    nothing = F.lit(None).cast(rows.select(symbol.alias("s")).schema["s"].dataType)

    def event(span: Column, level: Column, at: Column, stop: Column, own: Column) -> Column:
        return F.struct(span.alias("of"), level.alias("level"), at.cast("int").alias("at"), stop.cast("int").alias("stop"), own.alias("own"))

    # nothing opens: no end
    begins = F.filter(F.array(event(F.when(at.isNotNull(), F.col("span")), F.when(at.isNotNull(), level), at, F.lit(None), symbol)), lambda e: e["own"]["name"].isNotNull())
    none = F.array().cast("array<int>")
    closed = F.when(F.col("before") + F.col("open") > F.col("after"), F.sequence(F.col("after").cast("int"), (F.col("before") + F.col("open") - 1).cast("int"))).otherwise(none)
    left = F.when(~F.col("blank") & (F.col("_prior")["indent"] >= F.col("indent")), F.sequence(F.col("indent"), F.col("_prior")["indent"])).otherwise(none)
    ends = [F.transform(closed, lambda x: event(F.lit("braces"), x, F.col("line"), F.col("line"), nothing)), F.transform(left, lambda x: event(F.lit("indent"), x, F.col("line"), F.col("_prior")["line"], nothing))]
    # all of a line at once: a file is read, lexed and sorted by lines in one pass
    events = solid.select("path", "_end", F.inline(F.concat(begins, *ends)))
    # from the end of the file backwards; of equal places the ends come first, so a line can close what it opens
    next_ = Window.partitionBy("path", "of", "level").orderBy(F.desc("at"), F.col("stop").isNull())
    found = events.withColumn("_stop", F.last("stop", True).over(next_)).where(F.col("own").isNotNull())
    end = F.when(F.col("of") == "braces", F.col("_stop")).when(F.col("of") == "indent", F.coalesce("_stop", F.when(F.col("_end") > F.col("own")["line"], F.col("_end"))))
    return found.select("path", "own.*", end.alias("end_line"))


def _signature() -> Column:
    return F.substring(F.trim("text"), 1, MAX_SIGNATURE).alias("signature")


def outline(files: DataFrame) -> DataFrame:
    """``(path, language, kind, name, line, end_line, signature)``, one row a symbol.

    ``end_line`` is null for unbalanced code and for kinds without a body.
    """
    return _spans(_measured(files)).select("path", "language", "kind", "name", "line", F.col("end_line").cast("int").alias("end_line"), _signature())


_NO_METHODS = ["if", "for", "while", "switch", "catch", "return", "function", "new", "throw", "typeof", "await", "do", "else", "with"]
_MEMBER = r"^\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)"


def members(files: DataFrame) -> DataFrame:
    """``(path, parent, kind, name, line, end_line, signature)``: methods and properties of classes and interfaces, one level down.

    In languages with braces a member's line begins at the depth of the body; in Python it is any ``def`` in the
    span of the class, however deep.
    """
    rows = _measured(files)
    text, js, py = F.col("text"), F.col("language").isin(*_JS), F.col("language") == "python"
    method = F.nullif(F.regexp_extract(text, _MEMBER + r"\s*(?:<[^>]*>)?\(", 1), F.lit(""))
    method = F.when(~method.isin(_NO_METHODS), method)
    field = F.nullif(F.regexp_extract(text, _MEMBER + r"\s*[?!]?\s*(?::|=(?!>|=)|;)", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract(text, r"^\s+(?:async\s+)?def\s+([A-Za-z_]\w*)", 1), F.lit(""))
    name = F.when(js & F.col("kind").isNull(), F.coalesce(method, field)).when(py, inner)
    kind = F.when(py | method.isNotNull(), "method").otherwise("property")
    span = F.when(py, "indent").when(method.isNotNull() & (F.col("open") > 0), "braces").otherwise("none")
    owners = _spans(rows).where(F.col("kind").isin("class", "interface") & F.col("end_line").isNotNull())
    owners = owners.select("path", "line", F.when(py, F.lit(0)).otherwise(F.col("before")).alias("level"), F.struct(F.col("name").alias("parent"), F.col("end_line").alias("to")).alias("_owner"))
    own = _spans(rows.withColumns({"_name": name, "_kind": kind, "_span": span}).withColumns({"kind": F.when(F.col("_name").isNotNull(), F.col("_kind")), "name": F.col("_name"), "span": F.col("_span")}))
    own = own.withColumn("level", F.when(py, F.lit(0)).otherwise(F.col("before") - 1))
    last = F.last("_owner", True).over(Window.partitionBy("path", "level").orderBy("line"))
    both = own.unionByName(owners, allowMissingColumns=True).withColumn("_owner", last)
    inside = both.where(F.col("name").isNotNull() & (F.col("line") <= F.col("_owner")["to"]))
    return inside.select("path", F.col("_owner")["parent"].alias("parent"), "kind", "name", "line", F.col("end_line").cast("int").alias("end_line"), _signature())


def leading_comments(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbols`` with ``comment``: the block of comment lines above, from which one blank line may part it; null without."""
    numbered = files.select("path", F.posexplode(lines(F.col("text"))).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), F.trim(F.translate("text", "\t", " ")).alias("text"))
    text = F.col("text")
    is_comment = text.rlike(r"^(?://|#(?!\[|include|define)|/\*|\*(?:$|[ /])|\*/)")
    file = Window.partitionBy("path").orderBy("line")
    marked = numbered.withColumns({"_c": is_comment, "_block": F.sum((~is_comment).cast("int")).over(file), "_blank": text == ""})
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"^(?://+!?|#+|/\*+|\*+/?)", ""), r"\*+/$", ""))
    marked = marked.withColumn("_next", F.lead("_blank").over(file))
    blocks = marked.where("_c").groupBy("path", "_block").agg(F.max(F.struct("line", "_next")).alias("_last"), F.array_join(F.filter(F.sort_array(F.collect_list(F.struct("line", clean.alias("t"))))["t"], lambda t: t != ""), "\n").alias("comment"))
    last = F.col("_last")["line"]
    above = blocks.select("path", "comment", F.explode(F.when(F.col("_last")["_next"], F.array(last + 1, last + 2)).otherwise(F.array(last + 1))).alias("line"))
    return symbols.join(above, ["path", "line"], "left").select(*symbols.columns, "comment")


def imports(files: DataFrame, most: int = 200) -> DataFrame:
    """``(path, imports)``: what a file imports, once each, in order of appearance."""
    all_ = code_lines(files)
    found = F.lit(None).cast("string")
    for languages, pattern in IMPORTS:
        own = F.coalesce(_first(pattern, F.col("text")), F.nullif(F.regexp_extract("text", pattern, 2), F.lit("")))
        found = F.when(F.col("language").isin(*languages), F.trim(own)).otherwise(found)
    named = all_.select("path", "line", found.alias("import")).where(F.col("import").isNotNull())
    once = named.groupBy("path", "import").agg(F.min("line").alias("line"))
    ordered = once.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "import"))).alias("_all"))
    return ordered.select("path", F.slice(F.col("_all")["import"], 1, most).alias("imports"))


def symbol_lookup(symbols: DataFrame, path: str, name: str) -> DataFrame:
    """The first symbol of that name in a file, or else the five nearest names, by edit distance."""
    own = symbols.where(F.col("path") == path).withColumn("distance", F.levenshtein(F.lower("name"), F.lit(name.lower())))
    exact = own.where(F.col("name") == name).orderBy("line").limit(1)
    near = own.orderBy("distance", "name", "line").limit(5)
    return exact if exact.limit(1).count() else near
