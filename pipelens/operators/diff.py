"""Comparing snapshots, manifests, runs and archives by full outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.functions.hashing import merkle_digest


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two tables (path, mtime, size): new, changed (later mtime or other size) or deleted."""
    o = old.select("path", F.col("mtime").alias("o_mtime"), F.col("size").alias("o_size"), F.lit(True).alias("o"))
    n = new.select("path", F.col("mtime").alias("n_mtime"), F.col("size").alias("n_size"), F.lit(True).alias("n"))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when((F.col("n_mtime") > F.col("o_mtime")) | (F.col("n_size") != F.col("o_size")), "changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


#: Kinds of a manifest's entries: rank of the reason, rank if one is gone (None: that is no reason), and the reasons.
ENTRIES = {
    "file": (2, 3, "file added", "file modified"),
    "env": (4, None, "environment variable added", "environment variable changed"),
    "dep": (5, None, "dependency added", "dependency rebuilt"),
}


def why(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(task, reason, item): why each current task has to run again, null reason if nothing differs.

    Both tables have task, command, file_hashes, env_vars, dep_hashes; the maps
    are compared entry by entry, as ``why_rows`` does.
    """
    maps = {"file": "file_hashes", "env": "env_vars", "dep": "dep_hashes"}

    def rows(manifests: DataFrame) -> DataFrame:
        out = None
        for kind, column in maps.items():
            more = manifests.select("task", F.lit(kind).alias("kind"), F.explode(column).alias("k", "v"))
            out = more if out is None else out.union(more)
        return out

    return why_rows(previous.select("task", "command"), rows(previous), current.select("task", "command"), rows(current))


def why_rows(previous: DataFrame, previous_entries: DataFrame, current: DataFrame, current_entries: DataFrame) -> DataFrame:
    """``why`` over manifests that are tables: tasks (task, command), entries (task, kind, k, v) of the kinds of ``ENTRIES``.

    Entries meet by task, kind and name, so a task may have any number of
    them. Of several differences the first kind, then the smallest name, is
    given; an environment variable or dependency that is gone is none.
    """
    both = current.select("task", F.col("command").alias("n_command")).join(previous.select("task", F.col("command").alias("o_command"), F.lit(True).alias("there")), "task", "left")
    changes = both.where("there IS NULL").select("task", F.lit(0).alias("rank"), F.lit("no previous manifest").alias("reason"), F.lit("").alias("item"))
    changes = changes.union(both.where("there AND n_command <> o_command").select("task", F.lit(1), F.lit("command changed"), F.lit("")))
    n = current_entries.join(previous.select("task"), "task", "left_semi").select("task", "kind", "k", F.col("v").alias("n_v"))
    o = previous_entries.join(current.select("task"), "task", "left_semi").select("task", "kind", "k", F.col("v").alias("o_v"))
    rank, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for kind, (at, gone, added, changed) in ENTRIES.items():
        here = F.col("kind") == kind
        reason = F.when(here & F.col("o_v").isNull(), added).when(here & F.col("n_v").isNull(), "file deleted" if gone else None).when(here & (F.col("n_v") != F.col("o_v")), changed).otherwise(reason)
        rank = F.when(here & F.col("n_v").isNull(), gone or at).when(here, at).otherwise(rank)
    changes = changes.union(n.join(o, ["task", "kind", "k"], "full_outer").select("task", rank, reason.alias("reason"), F.col("k")).where("reason IS NOT NULL"))
    first = changes.groupBy("task").agg(F.min(F.struct("rank", "item", "reason")).alias("c")).select("task", "c.reason", "c.item")
    return current.select("task").join(first, "task", "left").select("task", "reason", "item")


def early_cutoff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(task, cutoff): pure tasks whose non-empty outputs are the same as before, so dependents need not run.

    Both have task, pure, output_hashes.
    """
    n = current.select("task", "pure", merkle_digest(F.col("output_hashes")).alias("n_digest"))
    o = previous.select("task", merkle_digest(F.col("output_hashes")).alias("o_digest"))
    return n.join(o, "task", "left").select("task", (F.coalesce("pure", F.lit(False)) & (F.col("n_digest") != "") & F.coalesce(F.col("n_digest") == F.col("o_digest"), F.lit(False))).alias("cutoff"))


def cutoff_token(pure, digest, task_hash):
    """What dependents hash of a task: its outputs if it is pure and has some, else its own fingerprint."""
    return F.when(pure & (digest != ""), F.concat(F.lit("out:"), digest)).otherwise(task_hash)


def run_compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path, match, status) of two runs' artifacts (path, sha256, size): equal digests match; so do two missing ones (NONE)."""
    a = first.select("path", F.col("sha256").alias("a"), F.lit(True).alias("in_a"))
    b = second.select("path", F.col("sha256").alias("b"), F.lit(True).alias("in_b"))
    status = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "NONE").when(F.col("a").isNull(), "ONLY_SECOND").when(F.col("b").isNull(), "ONLY_FIRST")
        .when(F.col("a") == F.col("b"), "MATCH").otherwise("MISMATCH")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).withColumn("match", F.col("status").isin("MATCH", "NONE"))


def archive_verify(manifest: DataFrame, archive: DataFrame) -> DataFrame:
    """(path, status) of a manifest against the archived files: ok, mismatch, missing, or extra, which is allowed."""
    m = manifest.select("path", F.col("sha256").alias("m"))
    a = archive.select("path", F.col("sha256").alias("a"))
    status = F.when(F.col("m").isNull(), "extra").when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("m"), "ok").otherwise("mismatch")
    return m.join(a, "path", "full_outer").select("path", status.alias("status")).withColumn("valid", F.col("status").isin("ok", "extra"))


def trusted_signatures(signatures: DataFrame, ring: DataFrame, revoked: DataFrame) -> DataFrame:
    """Signatures whose key is in the ring and not revoked."""
    return signatures.join(ring.select("key_id"), "key_id", "left_semi").join(revoked.select("key_id"), "key_id", "left_anti")
