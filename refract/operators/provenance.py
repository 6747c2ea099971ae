"""Whether signed provenance still matches: what claims want against what a walk over the file found (sources.walk).

A walked file is one row, and a check is an expression over it, so any number of checks costs one scan.  Checks
are three-valued, null meaning not checked.  Signatures and certificates are verified in operators.signatures;
here the best status is ``partial``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source types that say a model made or edited the content.
AI_SOURCES = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "compositeSynthetic")


def _field(kind: str, name: str, json: str = "content") -> Column:
    return F.from_json(F.get_json_object(json, f"$.{name}"), kind)


def _tail(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def fact_ok(f: Column) -> Column:
    """Whether what a fact of a walked file wants was found; null if its digest wasn't computed."""
    return F.when(~f["found"], False).when(f["got"].isNotNull(), (f["got"] == f["want"]) | F.coalesce(f["also"] == f["want"], F.lit(False)))


def _told(f: Column) -> Column:
    return F.struct(f["kind"].alias("kind"), f["manifest"].alias("manifest"), f["label"].alias("label"), fact_ok(f).alias("ok"))


def checks(walked: DataFrame, more: Column | None = None) -> DataFrame:
    """path, kind (assertion, ingredient, content), manifest, label, ok of every comparison, of any manifest of a file.

    more: further such structs of a file, from operators.signatures.
    """
    every = F.transform("facts", _told)
    return walked.select("path", F.explode(every if more is None else F.concat(every, more)).alias("c")).select("path", "c.*")


def assertion_checks(walked: DataFrame) -> DataFrame:
    """path, manifest, label, ok: whether each assertion that a claim lists is there and has its digest."""
    return checks(walked).where("kind = 'assertion'").drop("kind")


def ingredient_checks(walked: DataFrame) -> DataFrame:
    """path, label, ok: whether each earlier manifest that an ingredient names has its digest, with or without header."""
    return checks(walked).where("kind = 'ingredient'").select("path", "label", "ok")


def content_checks(walked: DataFrame) -> DataFrame:
    """path, ok: whether the file outside of what is left out has the signed digest; null for digests that aren't computed."""
    return checks(walked).where("kind = 'content'").select("path", "ok")


def active(boxes: DataFrame) -> DataFrame:
    """The boxes of the last manifest of each file."""
    return boxes.where("manifest = manifests - 1")


def digest(content: Column, alg: Column) -> Column:
    """Hex digest by the name of its algorithm; null for others."""
    out = F
    for bits in (256, 384, 512):
        out = out.when(F.coalesce(alg, F.lit("sha256")) == f"sha{bits}", F.sha2(content, bits))
    return out


def actions(boxes: DataFrame) -> DataFrame:
    """path, action, agent, when, source (last part of the source type), ai."""
    kind = "array<struct<action:string,softwareAgent:string,when:string,digitalSourceType:string>>"
    a = active(boxes).where("box = 'assertion' AND label LIKE 'c2pa.actions%'").select("path", F.explode(_field(kind, "actions")).alias("a"))
    source = _tail(F.col("a.digitalSourceType"))
    agent = F.coalesce(F.get_json_object("a.softwareAgent", "$.name"), F.col("a.softwareAgent"))
    return a.select("path", F.col("a.action").alias("action"), agent.alias("agent"), F.col("a.when").alias("when"), source.alias("source"), F.coalesce(source.isin(*AI_SOURCES), F.lit(False)).alias("ai"))


def broken() -> Column:
    """Whether a walked file's store can't be judged: damaged, empty or without a newest claim."""
    return F.col("error").isNotNull() | F.try_element_at("manifests", F.lit(-1))["claim"].isNull()


def status(walked: DataFrame) -> DataFrame:
    """path, status (unreadable, invalid or partial), and counts of checks that held, failed and weren't made."""
    n = lambda keep: F.size(F.filter("facts", lambda f: F.coalesce(keep(fact_ok(f)), F.lit(False)))).cast("bigint")
    # The signature is one more that isn't made here.
    open_ = n(lambda ok: ok.isNull()) + F.when(F.size("manifests") > 0, 1).otherwise(0)
    out = walked.select("path", broken().alias("broken"), n(lambda ok: ok).alias("held"), n(lambda ok: ~ok).alias("failed"), open_.alias("unchecked"))
    return out.select("path", F.when(F.col("broken"), "unreadable").when(F.col("failed") > 0, "invalid").otherwise("partial").alias("status"), "held", "failed", "unchecked")
