"""Code-metric expressions on whole file texts.

Every count is one pass of a built-in over the text of one row: no line is exploded,
nothing is shuffled, and a file is never split. Line rules ("a trimmed line starts
with ...") become multi-line patterns over the text with its lines trimmed once.

Flags used in the patterns: ``d`` only ``\\n`` ends a line, ``m`` anchors match at
lines, ``s`` the dot matches newlines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.texts import SPACE_CLASS, count_literal, trim_lines

# Languages measured with the line rules shared by all of them.
GENERIC_LANGUAGES = ("Rust", "C", "C++", "Java", "Ruby", "C#")
SCRIPT_LANGUAGES = ("TypeScript", "JavaScript")

METRICS = ("function_count", "exported_symbols", "cyclomatic", "cognitive")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _extract(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def python_metrics(content: Column, trimmed: Column) -> dict[str, Column]:
    branches = _count(trimmed, r"(?dm)^(?:if |elif |for |while |except)")
    logic = count_literal(trimmed, " and ") + count_literal(trimmed, " or ")
    # The captured part of the indent is its length cut down to a multiple of four,
    # so the captures joined together hold four characters per nesting level.
    s = SPACE_CLASS
    indents = _extract(
        content,
        rf"(?dm)^((?:[ \t]{{4}})*+)[{s}]*+"
        rf"(?:(?:if |for |while )(?=[^\n]*[^{s}\n])|try:)",
        1,
    )
    levels = F.floor(F.octet_length(F.array_join(indents, "")) / 4).cast("bigint")
    return {
        "function_count": _count(trimmed, r"(?dm)^def "),
        "exported_symbols": _count(trimmed, r"(?dm)^(?:def (?!_)|class )"),
        "cyclomatic": F.lit(1) + branches + logic,
        "cognitive": F.size(indents).cast("bigint") + levels,
    }


def python_imports(trimmed: Column) -> Column:
    """Module paths of import lines, dots turned into slashes; ``_x`` is dropped."""
    s = SPACE_CLASS
    from_lines = _extract(trimmed, rf"(?dm)^from [{s}]*+([^{s}\n]+)", 1)
    import_lines = F.filter(
        _extract(trimmed, rf"(?dm)^import [{s}]*+([^{s}\n]+?),?(?![^{s}\n])", 1),
        lambda m: m != ",",
    )
    modules = F.filter(F.concat(from_lines, import_lines), lambda m: ~F.startswith(m, F.lit("_")))
    return F.transform(modules, lambda m: F.translate(m, ".", "/"))


def script_metrics(content: Column) -> dict[str, Column]:
    branch_words = ("if ", "else if ", "for ", "while ", "case ", "catch ")
    cyclomatic = count_literal(content, branch_words[0])
    for word in branch_words[1:]:
        cyclomatic = cyclomatic + count_literal(content, word)
    return {
        "function_count": count_literal(content, "function ") + count_literal(content, "=>"),
        "exported_symbols": count_literal(content, "export "),
        "cyclomatic": cyclomatic,
        "cognitive": F.lit(0).cast("bigint"),
    }


def generic_metrics(content: Column, trimmed: Column) -> dict[str, Column]:
    exported = ("pub fn ", "pub struct ", "pub enum ", "pub trait ", "public ")
    exports = count_literal(content, exported[0])
    for word in exported[1:]:
        exports = exports + count_literal(content, word)
    branches = _count(trimmed, r"(?dm)^(?:if |\} else if |else if |for |while |loop )")
    arms = _count(trimmed, r"(?dm)^(?:match |[^\n]*?=> )")
    errors = _count(trimmed, r"(?dm)^(?:catch|[^\n]*?Err\()")
    return {
        "function_count": _count(
            trimmed, r"(?dm)^(?:fn |pub fn |func |def |public |private )"),
        "exported_symbols": exports,
        "cyclomatic": F.lit(1) + branches + arms + errors,
        "cognitive": F.lit(0).cast("bigint"),
    }


# Go texts: comments and literals become one space first, so that keywords inside
# them do not count. Whichever of the alternatives starts first consumes the rest.
_GO_BLANK = (
    r"(?s)/\*.*?\*/|//[^\n]*+|`[^`]*+`"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
)
# A top-level function: its first line, then everything up to a brace in column one.
_GO_FUNC = r"(?dms)^func\b(?:[^\n]*\}[ \t\r]*$|.*?(?:^\}|\z))"
_GO_BRANCH = r"\b(?:if|for|case)\b|\bdefault\s*:|&&|\|\|"
_GO_NEST = r"\b(if|for)\b|\b(switch)\b(?![^{\n]*\.\(type\))|\b(func)\s*\([^{\n]*\{"
_GO_HEADER = r"(?dms)\A.*?(?=^(?:func|type|var|const)\b|\z)"

_GO_IMPORT = r'(?s)(?:\A|[;\n])\s*import\b\s*(\([^)]*\)|(?:[\w.]+\s+)?(?:"[^"\n]*"|`[^`]*`))'


def go_blanked(content: Column) -> Column:
    return F.regexp_replace(content, _GO_BLANK, " ")


def go_parses(blanked: Column) -> Column:
    """A Go file opens with its package clause; anything else is not measured."""
    return F.rlike(blanked, F.lit(r"\A\s*package\s+\w"))


def go_metrics(blanked: Column) -> dict[str, Column]:
    functions = _extract(blanked, _GO_FUNC, 0)
    text = F.array_join(functions, "\n")
    count = _count(blanked, r"(?dm)^func\b")

    def cost(body: Column) -> Column:
        # Drop the signature, then fold over the constructs in source order: the
        # k-th branching construct costs k, a function literal one more than the
        # number of branching constructs before it.
        inner = F.regexp_replace(body, r"(?dms)\Afunc\b.*?\{[ \t\r]*$|\Afunc\b", "")
        marks = F.regexp_replace(inner, "(?s)" + _GO_NEST + "|.", "$1$2$3")
        words = _extract(marks, "if|for|switch|func", 0)
        fold = F.aggregate(
            words,
            F.struct(F.lit(0).alias("cost"), F.lit(0).alias("depth")),
            lambda acc, w: F.struct(
                (acc["cost"] + 1 + acc["depth"]).alias("cost"),
                (acc["depth"] + F.when(w == "func", 0).otherwise(1)).alias("depth"),
            ),
        )
        return fold["cost"]

    cognitive = F.aggregate(
        F.transform(functions, cost), F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    # Exported names: functions and methods, then the name lists of type, var and
    # const declarations, alone or one per line of a top-level group.
    exported_funcs = _count(blanked, r"(?dm)^func\s+(?:\([^)]*\)\s*)?\p{Lu}")
    names = r"(\w+(?:[ \t]*,[ \t]*\w+)*)"
    single = _extract(blanked, rf"(?dm)^[ \t]*(?:type|var|const)[ \t]+{names}", 1)
    groups = _extract(blanked, r"(?dms)^(?:type|var|const)[ \t]*\([ \t\r]*$(.*?)^\)", 1)
    grouped = _extract(F.array_join(groups, "\n"), rf"(?dm)^\t{names}", 1)
    listed = F.concat_ws(" ", F.array_join(single, " "), F.array_join(grouped, " "))
    exported_names = _count(listed, r"\b\p{Lu}")
    return {
        "function_count": count,
        "exported_symbols": exported_funcs + exported_names,
        "cyclomatic": count + _count(text, _GO_BRANCH),
        "cognitive": cognitive,
    }


def go_imports(content: Column) -> Column:
    """Import paths that are relative or a single word."""
    header = F.regexp_extract(content, _GO_HEADER, 0)
    bare = F.regexp_replace(header, r"(?s)/\*.*?\*/|//[^\n]*+", " ")
    # Whole declarations, single or grouped, however they are laid out; then their strings.
    declared = _extract(bare, _GO_IMPORT, 1)
    quoted = _extract(F.array_join(declared, "\n"), r'"[^"\n]*"|`[^`]*`', 0)
    paths = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    return F.filter(
        paths,
        lambda p: (p != "") & (F.startswith(p, F.lit(".")) | ~F.contains(p, F.lit("/"))),
    )


def metrics_struct(language: Column, content: Column, prepared: Column) -> Column:
    """All metrics and imports of a file as one struct; only its language's branch runs.

    ``prepared`` is the text from :func:`prepared_text`.
    """
    no_imports = F.array().cast("array<string>")

    def pack(metrics: dict[str, Column], imports: Column) -> Column:
        return F.struct(
            *[metrics[name].cast("bigint").alias(name) for name in METRICS],
            imports.alias("imports"),
        )

    nothing = {name: F.lit(0).cast("bigint") for name in METRICS}
    go = F.when(
        go_parses(prepared), pack(go_metrics(prepared), go_imports(content))
    ).otherwise(pack(nothing, no_imports))
    return (
        F.when(language == "Python",
               pack(python_metrics(content, prepared), python_imports(prepared)))
        .when(language.isin(*SCRIPT_LANGUAGES), pack(script_metrics(content), no_imports))
        .when(language.isin(*GENERIC_LANGUAGES),
              pack(generic_metrics(content, prepared), no_imports))
        .when(language == "Go", go)
        .otherwise(pack(nothing, no_imports))
    )


def prepared_text(language: Column, content: Column) -> Column:
    """Trimmed lines, blanked Go text, or the text itself where neither is needed."""
    return (
        F.when(language == "Go", go_blanked(content))
        .when(language.isin("Python", *GENERIC_LANGUAGES), trim_lines(content))
        .otherwise(content)
    )
