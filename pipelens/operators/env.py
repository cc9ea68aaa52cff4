"""Environment files as rows: audit, cloak, merge, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.functions.paths import is_sensitive
from pipelens.functions.secrets import TOKEN_PREFIX, cloak_token, env_entry, is_placeholder, mask, risk


def lines_of(files: DataFrame, path: str, text: str) -> DataFrame:
    """(file, line_no, line) from 1; a last empty line and closing carriage returns are not part of the text."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\n\\z", ""), "\r(?=\n|\\z)", "")
    return files.where(F.col(text) != "").select(F.col(path).alias("file"), F.posexplode(F.split(clean, "\n")).alias("pos", "line")).select("file", (F.col("pos") + 1).alias("line_no"), "line")


def entries(lines: DataFrame) -> DataFrame:
    """Lines with key, value and is_comment. A generator makes these once, whatever uses them."""
    return lines.select(*lines.columns, F.inline(F.array(env_entry(F.col("line")))))


def findings(lines: DataFrame) -> DataFrame:
    """(file, line_no, key, risk, masked) of every secret; placeholders are none."""
    found = entries(lines).where("NOT is_comment AND key <> ''").where(~F.col("value").startswith(TOKEN_PREFIX))
    found = found.select("file", "line_no", "key", "value", F.explode(F.array(risk(F.col("key"), F.col("value")))).alias("risk"))
    return found.where("risk <> 'LOW'").select("file", "line_no", "key", "risk", mask(F.col("value")).alias("masked"))


def audit(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(files_audited, total_secrets, status) over the files whose names are sensitive."""
    sensitive = files.where(is_sensitive(F.col(path)))
    found = findings(lines_of(sensitive, path, text)).agg(F.count("*").alias("total_secrets"))
    return sensitive.agg(F.count("*").alias("files_audited")).join(F.broadcast(found)).withColumn("status", F.when(F.col("total_secrets") > 0, "VULNERABLE").otherwise("SECURED"))


def cloak(lines: DataFrame) -> DataFrame:
    """(file, line_no, line, is_secret): secret values replaced by tokens that key and value determine."""
    e = entries(lines).withColumn("is_secret", ~F.col("is_comment") & (risk(F.col("key"), F.col("value")) != "LOW"))
    cloaked = F.when(F.col("is_secret"), F.concat("key", F.lit("="), cloak_token(F.col("key"), F.col("value")))).otherwise(F.col("line"))
    return e.select("file", "line_no", cloaked.alias("line"), "is_secret", "is_comment")


def joined(lines: DataFrame) -> DataFrame:
    """(file, text): cloaked or merged lines (file, line_no, line) as files again, in the order of their numbers, with a closing newline."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("file").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def cloak_counts(cloaked: DataFrame) -> DataFrame:
    return cloaked.groupBy("file").agg(F.count_if(~F.col("is_comment")).alias("n_total"), F.count_if("is_secret").alias("n_secret"), F.count_if(~F.col("is_comment") & ~F.col("is_secret")).alias("n_public"))


def merge(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """(line_no, action, line): a proposed file (line_no, line) against the existing one.

    Tokens are put back to what they stand for, or to the key's own secret; of
    several values with one token (it has eight digits) the one of the same key
    counts, else the last. Placeholders do not replace a secret; other new keys are added and other
    new values taken. Keys that the proposal lacks are not carried over. Of a
    key that exists twice the last line counts.
    """
    old = entries(existing).where("NOT is_comment AND key <> ''")
    by_key = old.groupBy("key").agg(F.max_by("value", "line_no").alias("o_value")).withColumn("o_secret", risk(F.col("key"), F.col("o_value")) != "LOW")
    secrets = old.where(risk(F.col("key"), F.col("value")) != "LOW").withColumn("token", cloak_token(F.col("key"), F.col("value")))
    own = secrets.groupBy("key", F.col("token").alias("value")).agg(F.max_by("value", "line_no").alias("own_value"))
    tokens = secrets.groupBy(F.col("token").alias("value")).agg(F.max_by("value", "line_no").alias("any_value"))
    new = entries(proposed).join(by_key.hint("merge"), "key", "left").join(own.hint("merge"), ["key", "value"], "left").join(tokens.hint("merge"), "value", "left").withColumn("t_value", F.coalesce("own_value", "any_value"))
    is_token, secret = F.col("value").startswith(TOKEN_PREFIX), F.coalesce("o_secret", F.lit(False))
    action = (
        F.when(F.col("is_comment"), "comment")
        .when(is_token & F.col("t_value").isNotNull(), "restored")
        .when((is_token | is_placeholder(F.col("value"))) & secret, "kept")
        .when(F.col("o_value").isNull(), "added")
        .when(F.col("o_value") != F.col("value"), "updated")
        .otherwise("unchanged")
    )
    out = new.withColumn("action", action)
    line = F.when(F.col("action") == "restored", F.concat("key", F.lit("="), "t_value")).when(F.col("action") == "kept", F.concat("key", F.lit("="), "o_value")).otherwise(F.col("line"))
    return out.select("line_no", "action", line.alias("line"))


def precedence(lines: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(key, value) over several files: the file of the lowest rank, then its first line, counts."""
    rank = F.lit(len(ranks))
    for name, r in ranks.items():
        rank = F.when(F.col("file") == name, r).otherwise(rank)
    return entries(lines).where("NOT is_comment AND key <> ''").groupBy("key").agg(F.min_by("value", F.struct(rank.alias("r"), "line_no")).alias("value"))
