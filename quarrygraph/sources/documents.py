"""Notebooks and single-file components: code inside other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOTEBOOK = "metadata struct<kernelspec:struct<language:string>>, cells array<struct<cell_type:string,source:string>>"
_SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script>"


def notebook(text: Column) -> Column:
    """struct<code, language, error>: code cells joined by newlines (a list of lines is concatenated), kernel language ('python' by default), error for text that is no JSON object."""
    nb = F.from_json(text, _NOTEBOOK, {"mode": "PERMISSIVE"})
    valid = F.coalesce(F.get_json_object(text, "$").startswith("{"), F.lit(False))

    def source(cell: Column) -> Column:
        lines = F.from_json(cell["source"], "array<string>")
        return F.coalesce(F.when(cell["source"].startswith("[") & lines.isNotNull(), F.array_join(lines, "")), cell["source"], F.lit(""))

    code = F.array_join(F.transform(F.filter(F.coalesce(nb["cells"], F.array().cast("array<struct<cell_type:string,source:string>>")), lambda c: c["cell_type"] == "code"), source), "\n")
    return F.struct(
        F.when(valid, code).alias("code"),
        F.when(valid, F.lower(F.coalesce(nb["metadata"]["kernelspec"]["language"], F.lit("python")))).alias("language"),
        F.when(~valid, F.lit("Invalid notebook JSON")).alias("error"),
    )


def scripts(text: Column) -> Column:
    """array<struct<content, lang, line_offset, is_setup>>: the script blocks of a component in order."""
    attributes, bodies = F.regexp_extract_all(text, F.lit(_SCRIPT), 1), F.regexp_extract_all(text, F.lit(_SCRIPT), 2)
    # the text is cut at its blocks; the lines before a block are those of the parts and blocks before it
    parts = F.split(text, _SCRIPT)
    opening = F.regexp_extract_all(text, F.lit(r"(?is)(<script\b[^>]*>)(.*?)</script>"), 1)
    whole = F.regexp_extract_all(text, F.lit(r"(?is)(<script\b[^>]*>.*?</script>)"), 1)
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def block(body: Column, i: Column) -> Column:
        before = F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda a, k: a + lines(F.get(parts, k)) + F.when(k < i, lines(F.get(whole, k))).otherwise(lines(F.get(opening, k))))
        at = F.get(attributes, i)
        typed = at.contains('lang="ts"') | at.contains("lang='ts'")
        return F.struct(body.alias("content"), F.when(typed, "ts").otherwise("js").alias("lang"), before.alias("line_offset"), at.contains("setup").alias("is_setup"))

    return F.transform(bodies, block)


def code_of(files: DataFrame) -> DataFrame:
    """files (path, language, text) with what a parser reads: code, code_language, line_offset, note. Of a component, the first script block."""
    is_notebook, is_component = F.col("path").endswith(".ipynb"), F.col("language") == "vue"
    nb, script = notebook(F.col("text")), F.get(scripts(F.col("text")), 0)
    out = files.withColumn("nb", F.when(is_notebook, nb)).withColumn("script", F.when(is_component, script))
    return out.select(
        *files.columns,
        F.coalesce("nb.code", F.when(is_component, F.coalesce("script.content", F.lit(""))), F.when(is_notebook, F.lit("")), F.col("text")).alias("code"),
        F.coalesce("nb.language", F.when(is_component, F.when(F.col("script.lang") == "ts", "typescript").otherwise("javascript")), F.col("language")).alias("code_language"),
        F.coalesce("script.line_offset", F.lit(0)).alias("line_offset"),
        F.col("nb.error").alias("note"),
    )
