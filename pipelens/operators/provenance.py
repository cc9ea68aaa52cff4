"""Provenance records: statements, envelopes, key ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types that the public statement and envelope formats prescribe.
STATEMENT_TYPE = "https://in-toto.io/Statement/v1"
PREDICATE_TYPE = "https://slsa.dev/provenance/v1"
PAYLOAD_TYPE = "application/vnd.in-toto+json"


def statements(runs: DataFrame, builder: str) -> DataFrame:
    """(task, statement): JSON of a statement about each run's outputs, from task, command, hash and output_hashes.

    Subjects are in byte order of their names, so equal runs have equal texts.
    """
    subject = F.transform(F.array_sort(F.map_entries("output_hashes")), lambda e: F.struct(e["key"].alias("name"), F.struct(e["value"].alias("sha256")).alias("digest")))
    definition = F.struct(F.struct(F.col("task"), F.col("command")).alias("externalParameters"), F.col("hash").alias("inputDigest"))
    predicate = F.struct(definition.alias("buildDefinition"), F.struct(F.struct(F.lit(builder).alias("id")).alias("builder")).alias("runDetails"))
    body = F.struct(F.lit(STATEMENT_TYPE).alias("_type"), subject.alias("subject"), F.lit(PREDICATE_TYPE).alias("predicateType"), predicate.alias("predicate"))
    return runs.select("task", F.to_json(body).alias("statement"))


def pre_authentication(payload: Column, kind: str = PAYLOAD_TYPE) -> Column:
    """What an envelope's signature covers: version, type and payload with their lengths in bytes."""
    return F.concat_ws(" ", F.lit("DSSEv1"), F.lit(str(len(kind.encode()))), F.lit(kind), F.octet_length(payload).cast("string"), payload)


def envelope(payload: Column, key_id: Column, signature: Column, kind: str = PAYLOAD_TYPE) -> Column:
    """JSON of an envelope around a payload that was signed elsewhere."""
    signatures = F.array(F.struct(key_id.alias("keyid"), signature.alias("sig")))
    return F.to_json(F.struct(F.lit(kind).alias("payloadType"), F.base64(F.encode(payload, "UTF-8")).alias("payload"), signatures.alias("signatures")))


def key_id(public_key: Column) -> Column:
    return F.sha2(public_key, 256)
