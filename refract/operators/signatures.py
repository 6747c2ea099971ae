"""Who signed a file's provenance, and the verdict on it: expressions over walked files, and one join with the roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import signatures_hold
from ..sources.certificates import certificates
from . import provenance


def label(name: Column, organisation: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" · ", name, organisation), F.lit("")), F.lit("Unknown"))


_CHECK = ("kind", "digest", "salt", "key_kind", "key", "message", "signature")


def _check(signed: Column, by: Column) -> Column:
    """What is needed to tell whether the key of ``by`` made the signature of ``signed``."""
    return F.struct(*(signed[c].alias(c) for c in _CHECK[:3]), *(by[c].alias(c) for c in _CHECK[3:5]), *(signed[c].alias(c) for c in _CHECK[5:]))


def _last() -> Column:
    return F.try_element_at("manifests", F.lit(-1))


def tested(walked: DataFrame) -> DataFrame:
    """The walked files with ``own``, whether each manifest's key made its signature, and ``links``, whether each of the
    newest one's certificates was signed by the next; null where an algorithm isn't known.

    All of a file's signatures are checked in one pass; equal ones are checked once in a task.
    """
    own = F.transform("manifests", lambda m: _check(m["signature"], F.get(m["chain"], 0)))
    chain = _last()["chain"]
    n = F.greatest(F.size(chain) - 1, F.lit(0))
    links = F.coalesce(F.zip_with(F.slice(chain, 1, n), F.slice(chain, 2, n), _check), F.slice(own, 1, 0))
    held = walked.withColumn("held", signatures_hold(F.concat(own, links)))
    m = F.size("manifests")
    return held.withColumn("own", F.slice("held", 1, m)).withColumn("links", F.slice("held", m + 1, F.size("held"))).drop("held")


def _all(column: Column | str) -> Column:
    """False if one is false, else null if one is null, else true."""
    no = F.coalesce(F.exists(column, lambda x: ~x), F.lit(False))
    return F.when(no, False).when(~F.exists(column, lambda x: x.isNull()), True)


def checks(walked: DataFrame) -> DataFrame:
    """path, kind, manifest, label, ok of every check: those of digests, of signatures (by manifests with a certificate)
    and of the newest manifest's chain."""
    place = F.size("manifests") - 1
    row = lambda kind, i, label, ok: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("manifest"), label.alias("label"), ok.alias("ok"))
    signed = F.filter(F.transform("manifests", lambda m, i: F.when(F.size(m["chain"]) > 0, row("signature", i, m["label"], F.get("own", i)))), lambda x: x.isNotNull())
    chain = F.when(F.size(_last()["chain"]) > 0, F.array(row("chain", place, _last()["label"], _all("links"))))
    return provenance.checks(tested(walked), F.concat(signed, F.coalesce(chain, F.slice(signed, 1, 0))))


def history(walked: DataFrame) -> DataFrame:
    """path, manifest, label, depth (0 the newest; null if nothing that it comes from names it), signer, signed, intact.

    signed: whether the manifest's own key signed it; intact: whether its assertions have their digests, and it has
    the one that each later manifest recorded of it.
    """
    return tested(walked).select("path", F.explode(versions()).alias("m")).select("path", "m.*")


def said() -> Column:
    """struct(marked, edited, algorithmic, agent, generator) of a walked file: what its newest manifest says of its making."""
    last = _last()
    kind = "actions array<struct<action:string,softwareAgent:string,digitalSourceType:string>>"
    told = F.filter(last["assertions"], lambda a: a["label"].startswith("c2pa.actions"))
    acts = F.coalesce(F.flatten(F.transform(told, lambda a: F.coalesce(F.from_json(a["content"], kind)["actions"], F.array().cast(kind.removeprefix("actions "))))), F.array().cast(kind.removeprefix("actions ")))
    sources = F.transform(acts, lambda a: F.coalesce(F.substring_index(a["digitalSourceType"], "/", -1), F.lit("")))
    ai = F.filter(sources, lambda x: x.isin(*provenance.AI_SOURCES))
    agents = F.transform(F.filter(acts, lambda a: a["softwareAgent"].isNotNull()), lambda a: F.coalesce(F.get_json_object(a["softwareAgent"], "$.name"), a["softwareAgent"]))
    claim = lambda k: F.get_json_object(last["claim"], f"$.{k}")
    generator = F.concat_ws(" ", F.coalesce(claim("claim_generator_info[0].name"), claim("claim_generator_info.name"), claim("claim_generator")), F.coalesce(claim("claim_generator_info[0].version"), claim("claim_generator_info.version")))
    return F.struct(
        (F.size(ai) > 0).alias("marked"), F.exists(ai, lambda x: x.startswith("composite")).alias("edited"), F.array_contains(sources, "algorithmicMedia").alias("algorithmic"),
        F.coalesce(F.get(agents, 0), F.nullif(generator, F.lit(""))).alias("agent"), F.nullif(generator, F.lit("")).alias("generator"),
    )


def credentials() -> Column:
    """The struct that ai_origin.judged weighs, from a verdict with ``said``; null without provenance."""
    c = F.col
    whole = F.struct("status", "said.marked", "said.edited", "said.algorithmic", "said.agent", "said.generator", "organization")
    return F.when(c("status").isNotNull(), whole)


def versions() -> Column:
    fine = lambda m, i: _all(F.transform(F.filter("facts", lambda f: ((f["kind"] == "assertion") & (f["manifest"] == i)) | ((f["kind"] == "ingredient") & (f["label"] == m["label"]))), provenance.fact_ok))
    name = lambda c: F.coalesce(c["subject_name"], c["subject_org"])
    return F.transform(
        "manifests", lambda m, i: F.struct(i.alias("manifest"), m["label"].alias("label"), m["depth"].alias("depth"), name(F.get(m["chain"], 0)).alias("signer"), F.get("own", i).alias("signed"), fine(m, i).alias("intact"))
    )


def trust(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows (path, leaf, top, whole) with ``trusted_by``: the first root (der binary) that is the signer or the top of a
    whole chain, or that signed that top.  A chain with a link that failed or couldn't be checked is trusted by nobody."""
    a = certificates(anchors.select("der").where("der IS NOT NULL").distinct()).select(F.col("der").alias("root"), F.col("cert").alias("anchor"))
    key = lambda how, k: F.struct(F.lit(how).alias("how"), k.alias("key"))
    a = a.select("anchor", F.explode(F.array(key("same", F.col("root")), key("name", F.col("anchor.subject_der")))).alias("k")).select("k.*", "anchor")
    whole = lambda k: F.when(F.col("whole"), k)
    keys = F.array(key("same", F.col("leaf.der")), whole(key("same", F.col("top.der"))), whole(key("name", F.col("top.issuer_der"))))
    rows = found.select("*", F.explode_outer(F.array_distinct(F.array_compact(keys))).alias("k")).select("*", "k.*").join(a, ["how", "key"], "left")
    fits = F.when(F.col("how") == "same", F.col("anchor").isNotNull()).otherwise(F.get(signatures_hold(F.array(_check(F.col("top"), F.col("anchor")))), 0))
    name = F.when(fits, label(F.col("anchor.subject_name"), F.col("anchor.subject_org")))
    rest = [c for c in found.columns if c not in ("path", "top", "whole")]
    return rows.select("path", F.struct(*rest).alias("rest"), name.alias("name")).groupBy("path").agg(F.first("rest").alias("rest"), F.min("name").alias("trusted_by")).select("path", "rest.*", "trusted_by")


def verdict(walked: DataFrame, anchors: DataFrame, now: Column | None = None, **more: Column) -> DataFrame:
    """path, status, signer, organization, issuer, signed_at, trusted_by, headline of every walked file.

    status: unreadable (damaged, or without a certificate), invalid (a check failed, of the newest manifest or of one
    that it comes from), partial (content, a signature or the chain couldn't be checked), valid_untrusted or valid.
    Without a time stamp the certificate must be valid ``now`` (the current time).  Files without provenance that were walked
    all the same have a null status.  more: further columns, as expressions over walked files (``versions``, ``said``).
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if now is None else now
    c, last = F.col, _last()
    ok = F.transform("facts", lambda f: F.struct((f["kind"] == "content").alias("content"), provenance.fact_ok(f).alias("ok")))
    yes = lambda x: F.coalesce(x, F.lit(False))
    # An earlier manifest that can't be read counts as altered.
    lost = F.exists(F.slice("manifests", 1, F.greatest(F.size("manifests") - 1, F.lit(0))), lambda m: m["signature"]["error"].isNotNull() | m["claim"].isNull() | F.get(m["chain"], 0)["error"].isNotNull())
    t = tested(walked).withColumn("whole", _all("links")).withColumn("signed", _all("own"))
    found = t.select(
        "path", "whole", F.get(last["chain"], 0).alias("leaf"), F.try_element_at(last["chain"], F.lit(-1)).alias("top"), last["signature"]["signed_at"].alias("signed_at"),
        (yes(F.exists(ok, lambda x: ~x["ok"])) | ~yes(c("signed").isNull() | c("signed")) | ~yes(c("whole").isNull() | c("whole")) | yes(lost)).alias("failed"),
        (~yes(F.exists(ok, lambda x: x["content"] & x["ok"])) | c("signed").isNull() | c("whole").isNull()).alias("open"),
        (provenance.broken() | last["signature"]["error"].isNotNull()).alias("broken"), (c("container").isNull() & c("error").isNull()).alias("none"), *(x.alias(k) for k, x in more.items()),
    )
    j = trust(found, anchors)
    outdated = ~F.coalesce("signed_at", now).between(c("leaf.not_before"), c("leaf.not_after"))
    unreadable = c("broken") | c("leaf").isNull() | c("leaf.error").isNotNull()
    status = F.when(c("none"), None).when(unreadable, "unreadable").when(c("failed") | outdated, "invalid").when(c("open"), "partial").when(c("trusted_by").isNull(), "valid_untrusted").otherwise("valid")
    signer = F.coalesce("leaf.subject_name", "leaf.subject_org", F.when(c("leaf").isNotNull(), "Unknown"))
    out = j.select(
        "path", status.alias("status"), signer.alias("signer"), c("leaf.subject_org").alias("organization"), F.when(c("leaf").isNotNull(), label(c("leaf.issuer_name"), c("leaf.issuer_org"))).alias("issuer"),
        "signed_at", "trusted_by", *more,
    )
    return out.withColumn("headline", headline(c("status"), c("signer")))


def headline(status: Column, signer: Column) -> Column:
    who = F.coalesce(signer, F.lit("an unknown signer"))
    # The sentence on each status.
    return (
        F.when(status == "valid", F.concat(F.lit("Verified: signed by "), who, F.lit(", and the file has not changed since.")))
        .when(status == "valid_untrusted", F.concat(F.lit('Signature is valid and the file is unchanged, but "'), who, F.lit('" is not on the official C2PA trust list.')))
        .when(status == "partial", F.concat(F.lit("Signature by "), who, F.lit(" is valid, but the file's content could not be checked against it.")))
        .when(status == "invalid", "FAILED: the credentials do not match this file. It was changed after signing, or the credentials are forged or copied.")
        .when(status == "unreadable", "Content Credentials are present but could not be read.")
        .otherwise("No Content Credentials.")
    )
