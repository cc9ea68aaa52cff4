"""Rule-based repairs, completions and patches of sources as column expressions.

Two engines are known: ``rules`` applies its rules one after the other,
``sidecar`` takes the first that applies and, where none changes the line,
drops what stands behind its last word or bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.operators.diagnose import error_line

# Misspelt keywords, the heads of blocks, and what a completion adds behind what it knows.
TYPOS = (("defn", "def"), ("iff", "if"), ("retun", "return"), ("funtion", "function"), ("fnc", "func"), ("pacage", "package"))
HEADS = ("if ", "def ", "for ", "while ", "class ")
COMPLETIONS = {
    "func": " error {\n\treturn nil\n}", "err": " {\n\treturn err\n}", "block": ":\n    pass",
    "task": '\n      "inputs": ["**/*.go"],\n      "outputs": ["bin/app"]', "call": "ctx, task)", "member": "Run()", "other": " // auto completed",
}
BRACKETS = ("()", "[]", "{}")


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \r\t]+\z", "")


def _closed(line: Column) -> Column:
    """What closes the brackets that a line opens and does not close."""
    n = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return F.concat(*(F.repeat(F.lit(b), F.greatest(n(a) - n(b), F.lit(0))) for a, b in BRACKETS))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _indented(line: Column, previous: Column) -> Column:
    """A line at the indent of the one before, four more behind a colon."""
    depth = F.length(F.regexp_extract(previous, r"^(\s*)", 1)) + F.when(F.rtrim(previous).endswith(":"), 4).otherwise(0)
    return F.concat(F.repeat(F.lit(" "), F.coalesce(depth, F.lit(0)).cast("int")), F.regexp_replace(line, r"^[ \t]+", ""))


def repaired(line: Column, previous: Column, message: Column, lang: Column, engine: str = "rules") -> Column:
    """A line as its diagnostic asks for it; ``previous`` is the line before, null for the first."""
    low = F.lower(message)
    says = lambda *words: _any([low.contains(w) for w in words])
    if engine == "rules":
        python, bare = lang == "python", _rtrim(line)
        head = _any([F.trim(bare).startswith(h) for h in HEADS]) & ~bare.endswith(":")
        out = F.when(python & says("expected ':'", "invalid syntax") & head, F.concat(bare, F.lit(":"))).otherwise(line)
        out = F.when(python & says("indentationerror", "unexpected indent", "unindent does not match"), _indented(line, previous)).otherwise(out)
        out = F.when(says("unclosed", "unexpected eof"), F.concat(bare, _closed(line))).otherwise(out)
        fixed = out
        for bad, good in reversed(TYPOS):
            at = F.instr(out, bad + " ")
            once = F.concat(F.substring(out, F.lit(1), at - 1), F.lit(good), F.substring(out, at + len(bad), F.length(out)))
            fixed = F.when(out.contains(bad + " "), once).otherwise(fixed)
        return fixed
    whole = F.regexp_replace(line, r"\s+\z", "")
    colon = message.contains("expected ':'") | (_any([line.contains(h) for h in HEADS]) & ~whole.endswith(":"))
    typo = line
    for bad, good in reversed(TYPOS):
        typo = F.when(line.rlike(rf"\b{bad}\b"), F.regexp_replace(line, rf"\b{bad}\b", good)).otherwise(typo)
    holds = lambda *words: _any([message.contains(w) for w in words])
    out = (
        F.when(colon, F.concat(whole, F.lit(":")))
        .when(holds("IndentationError", "unexpected indent", "unindent does not match"), _indented(F.regexp_replace(line, r"^\s+", ""), previous))
        .when(holds("unclosed", "unexpected EOF", "was never closed"), F.concat(whole, _closed(line)))
        .when(holds("invalid syntax"), typo)
        .otherwise(line)
    )
    return F.when(out == line, F.regexp_replace(whole, r"""[^\w\s\)\]\}\:\;'"]+\z""", "")).otherwise(out)


def heal(snippets: DataFrame, engine: str = "rules", message: str = "diagnostic", code: str = "code", lang: str = "language") -> DataFrame:
    """``snippets`` with target_line (from 1), search_block, replace_block, unified_diff and success.

    The line is the one that the diagnostic names, within the code. Without a
    change there is no diff and no success; a null code or diagnostic heals nothing.
    """
    lines = F.split(F.col(code), "\n")
    rows = snippets.withColumn("_lines", lines).withColumn("target_line", error_line(F.col(message), F.size("_lines")).cast("int"))
    rows = rows.withColumn("search_block", F.get("_lines", F.col("target_line") - 1)).withColumn("_previous", F.get("_lines", F.col("target_line") - 2))
    rows = rows.withColumn("replace_block", repaired(F.col("search_block"), F.col("_previous"), F.col(message), F.col(lang), engine))
    rows = rows.withColumn("success", F.coalesce(F.col("replace_block") != F.col("search_block"), F.lit(False)))
    diff = F.format_string("--- before\n+++ after\n@@ -%d +%d @@\n-%s\n+%s\n", "target_line", "target_line", "search_block", "replace_block")
    return rows.withColumn("unified_diff", F.when(F.col("success"), diff)).drop("_lines", "_previous")


def completion(prefix: Column, suffix: Column, lang: Column) -> Column:
    """What to type next, by the last line before the cursor."""
    last = F.element_at(F.split(F.regexp_replace(prefix, r"\n\z", ""), "\n"), -1)
    bare, put = F.trim(last, F.lit(" \t\r")), {k: F.lit(v) for k, v in COMPLETIONS.items()}
    open_ = ~F.rtrim(last).endswith(":")
    return (
        F.when(bare.startswith("func ") & ~last.contains("{"), put["func"])
        .when(bare.startswith("if err != nil") & ~last.contains("{"), put["err"])
        .when(bare.startswith("def ") & open_, put["block"])
        .when(bare.startswith("for ") & open_ & (lang == "python"), put["block"])
        .when(suffix.contains("tasks.json") | last.contains("command"), put["task"])
        .when(last.endswith("("), put["call"]).when(last.endswith("."), put["member"]).otherwise(put["other"])
    )


def diff_blocks(diff: Column) -> Column:
    """struct(search_block, replace_block, target_line) of a unified diff; each line of a block ends with a newline, the line is 1 without a hunk."""
    lines = F.split(diff, "\n")
    block = lambda sign: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.concat(F.substring(x, F.lit(2), F.length(x)), F.lit("\n"))), "")
    hunks = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^@@.*?@@\s*-(\d+)|^@@\s*-(\d+)", 2)), lambda x: x != "")
    return F.struct(block("-").alias("search_block"), block("+").alias("replace_block"), F.coalesce(F.try_element_at(hunks, F.lit(-1)).cast("int"), F.lit(1)).alias("target_line"))


def line_of(text: Column, token: Column) -> Column:
    """The number from 0 of the first line that holds a token; 0 without one."""
    found = F.array_position(F.transform(F.split(text, "\n"), lambda x: x.contains(token)), True)
    return F.greatest(found - 1, F.lit(0)).cast("int")


def snippet(text: Column, most: int = 300) -> Column:
    """A trimmed text, cut behind ``most`` characters with three dots."""
    clean = F.trim(text, F.lit(" \t\r\n\x0b\x0c"))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.left(clean, F.lit(most)), F.lit("...")))


def short_digest(digest: Column) -> Column:
    return F.left(digest, F.lit(8))
