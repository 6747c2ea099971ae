"""Whether a file says that an AI made it: evidence from its bytes, its tags and its credentials, then one verdict.

A file is one row: raw, the text of the bytes that hold metadata, tags, its structs (ordinal, key, value), and the
verified credentials where there are any (operators.signatures).  Evidence is an array of that row, so the verdict
is a projection: nothing is joined or shuffled but tags and files that come as tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from . import origin, rules

#: Bytes at the start and at the end of a file that are searched.
HEAD_BYTES, TAIL_BYTES = 4 << 20, 1 << 20

# Markers of AI origin in raw text, and the names of generators near credentials.
SOURCE_TYPES = r"\b(compositeWithTrainedAlgorithmicMedia|trainedAlgorithmicMedia|compositeSynthetic)\b"
BY_SOFTWARE = r"\balgorithmicMedia\b"
GOOGLE, META = "Made with Google AI|SynthID", "Imagined with AI"
CREDENTIALS = r"c2pa\.(?:actions|hash|claim|assertions|created|opened|signature)|urn:c2pa|contentauth"
GENERATORS = (
    r"(OpenAI|ChatGPT|DALL[-·. ]?E[ -]?\d?|GPT-?4o|GPT[- ]?Image|Sora|Adobe[ _]?Firefly|Firefly|Google[ _]?(?:AI|Imagen|Gemini)|Gemini|Imagen[ -]?\d?|Veo[ -]?\d?"
    r"|Midjourney|Microsoft[ _]?(?:Designer|Bing)|Bing Image Creator|Meta AI|Amazon Titan|Stability AI|Leonardo|Runway|Truepic|ElevenLabs)"
)
JOB = r"Job ID:\s*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
SETTINGS = r"Steps:\s*\d+,\s*Sampler:"
REGION = (2048, 131_072)
JOB_REGION = 1500
PROMPT = r"([^\n\r]{8,600}?\s+--(?:v|ar|style|stylize|chaos|niji)\b[^\n\r]{0,80})"
# What a verdict on credentials is called in a report.
STATES = {"valid": "verified", "valid_untrusted": "signature valid, signer not on the trust list", "partial": "signature valid, file content not checked", "invalid": "FAILED verification"}

_NODES = "map<string,struct<class_type:string,inputs:map<string,string>>>"


def raw_text(content: Column) -> Column:
    """The first 4 MiB and the last MiB of the bytes as Latin-1 text without NULs."""
    size = F.octet_length(content)
    tail = F.when(size > HEAD_BYTES, F.concat(F.lit(b"\n"), F.substring(content, F.greatest(F.lit(HEAD_BYTES), size - TAIL_BYTES) + 1, F.lit(TAIL_BYTES)))).otherwise(F.lit(b""))
    return F.replace(F.decode(F.concat(F.substring(content, 1, HEAD_BYTES), tail), "ISO-8859-1"), F.lit("\0"), F.lit(""))


def _strip(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def _pick(text: Column, pattern: str, group: int = 1) -> Column:
    return _strip(F.regexp_extract(text, pattern, group))


def settings(text: Column) -> Column:
    """Generation settings after the first ``Steps: n, Sampler:`` of a text, with the prompts before it; null without one.

    The place and the two parts around it are elements of arrays, so that the text is searched once for all fields."""
    at = F.filter(F.array(F.regexp_instr(text, F.lit(SETTINGS))), lambda a: a > 0)
    before = lambda a: F.substring(text, F.greatest(F.lit(1), a - 4000), F.least(a - 1, F.lit(4000)))
    line = lambda a: F.regexp_extract(F.substring(text, a, F.lit(1200)), r"^[^\n]*", 0)
    parts = F.transform(at, lambda a: F.struct(F.regexp_replace(before(a), r"(?s)^.*?(?:UNICODE|ASCII|JIS)", "").alias("before"), line(a).alias("line")))
    fields = [("steps", "Steps"), ("sampler", "Sampler"), ("cfg", "CFG scale"), ("seed", "Seed"), ("size", "Size"), ("model_hash", "Model hash"), ("version", "Version"), ("model", "Model")]

    def read(p: Column) -> Column:
        prompt = _strip(F.regexp_replace(p["before"], r"(?s)Negative prompt:.*$", ""))
        negative = _pick(p["before"], r"(?s)Negative prompt:\s*(.*)$")
        return F.struct(prompt.alias("prompt"), negative.alias("negative"), *(_pick(p["line"], f"(?:^|, ){k}:\\s*([^,]+)").alias(n) for n, k in fields))

    return F.get(F.transform(parts, read), 0)


def graph(text: Column) -> Column:
    """What a ComfyUI node graph says, whatever its node ids are: struct(model, seed, steps, prompt, negative); null if text is none."""
    nodes = F.map_values(F.from_json(F.when(text.rlike(r"^\s*\{"), text), _NODES))
    nodes = F.filter(nodes, lambda n: n["class_type"].isNotNull())
    of = lambda n, k: F.try_element_at(n["inputs"], F.lit(k))
    named = lambda n: F.coalesce(of(n, "ckpt_name"), of(n, "unet_name"), of(n, "model_name"))
    model = F.get(F.filter(F.transform(nodes, named), lambda x: x.isNotNull()), 0)
    sampler = F.get(F.filter(nodes, lambda n: n["class_type"].contains("KSampler")), 0)
    texts = F.filter(F.transform(F.filter(nodes, lambda n: n["class_type"].contains("CLIPTextEncode")), lambda n: of(n, "text")), lambda x: x.isNotNull())
    return F.when(
        F.size(nodes) > 0,
        F.struct(
            F.regexp_replace(model, r"(?i)\.(safetensors|ckpt|gguf)$", "").alias("model"), F.coalesce(of(sampler, "seed"), of(sampler, "noise_seed")).alias("seed"), of(sampler, "steps").alias("steps"),
            F.get(texts, 0).alias("prompt"), F.get(texts, 1).alias("negative"),
        ),
    )


#: Verified credentials of a file; null where it has none that could be read.
CREDENTIALS_TYPE = "status string, marked boolean, edited boolean, algorithmic boolean, agent string, generator string, organization string"


def with_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with ``tags``, an array of their rows of (path, ordinal, key, value); other columns stay."""
    own = tags.groupBy("path").agg(F.collect_list(F.struct("ordinal", "key", "value")).alias("tags"))
    return files.join(own, "path", "left")


def _first_of_key(tags: Column) -> Column:
    """Sorted tags as a map; of equal keys the first counts."""
    first = F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, 1, i), lambda x: x["key"] == t["key"]))
    return F.map_from_entries(F.transform(first, lambda t: F.struct(t["key"], t["value"])))


def _facts(files: DataFrame) -> DataFrame:
    """One row a file: what its raw text and its single tags say."""
    empty = F.array().cast("array<struct<ordinal:int,key:string,value:string>>")
    f = files.withColumn("sorted", F.array_sort(F.filter(F.coalesce("tags", empty), lambda t: t["key"].isNotNull()))).withColumn("tags", _first_of_key(F.col("sorted")))
    raw, low, tag = F.col("raw"), F.col("low"), lambda k: F.try_element_at("tags", F.lit(k))
    there = lambda pattern, x: F.when(rules.may_hold(low, pattern), x)
    f = f.withColumn("low", F.lower("raw")).withColumn("at", there(CREDENTIALS, F.regexp_instr(raw, F.lit("(?i)" + CREDENTIALS))))
    at, region = F.col("at"), F.col("region")
    f = f.withColumn("region", F.when(at > 0, F.substring(raw, F.greatest(F.lit(1), at - REGION[0]), F.least(at - 1, F.lit(REGION[0])) + REGION[1])))
    shapes = F.filter(F.array(*(tag(k) for k in ("prompt", "workflow", "ai_prompt", "invokeai_metadata", "Comment", "comment"))), lambda x: x.rlike(r"^\s*\{"))
    js = lambda x, p: F.get_json_object(x, p)
    invoke = lambda x: F.coalesce(js(x, "$.model.model_name"), js(x, "$.model.name")).isNotNull() & F.coalesce(js(x, "$.positive_prompt"), js(x, "$.generation_mode")).isNotNull()
    novel = lambda x: js(x, "$.prompt").isNotNull() & F.coalesce(*(js(x, f"$.{k}") for k in ("steps", "seed", "sampler", "uc"))).isNotNull()
    f = f.withColumns(
        {
            "source_type": there(SOURCE_TYPES, F.nullif(F.regexp_extract(raw, SOURCE_TYPES, 1), F.lit(""))),
            "by_software": there(BY_SOFTWARE, raw.rlike(BY_SOFTWARE)),
            "google": there(GOOGLE, raw.rlike("(?i)" + GOOGLE)),
            "meta": there(META, raw.rlike("(?i)" + META)),
            "told": region.isNotNull(),
            "generator": F.replace(F.nullif(F.regexp_extract(region, "(?i)" + GENERATORS, 1), F.lit("")), F.lit("_"), F.lit(" ")),
            "signed_at": F.nullif(F.regexp_extract(region, r"\b(20\d{2}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)", 1), F.lit("")),
            "marked": F.coalesce(region.rlike(SOURCE_TYPES.replace("\\b", "")), F.lit(False)),
            "job": there(JOB, F.nullif(F.regexp_extract(raw, "(?i)" + JOB, 1), F.lit(""))),
            "sd": F.coalesce(*(settings(x) for x in (tag("ai_prompt"), tag("parameters"), tag("UserComment"))), there(SETTINGS, settings(raw))),
            "comfy": F.get(F.array_compact(F.transform(shapes, graph)), 0),
            "invoke": F.get(F.filter(shapes, invoke), 0),
            "novel": F.get(F.filter(shapes, novel), 0),
        }
    )
    f = f.withColumn("near", F.when(F.col("job").isNotNull(), F.regexp_instr(raw, F.lit("(?i)" + JOB))))
    near = F.col("near")
    around = F.substring(raw, F.greatest(F.lit(1), near - JOB_REGION), F.least(near - 1, F.lit(JOB_REGION)) + JOB_REGION)
    return f.withColumn("mj_prompt", F.when(F.col("job").isNotNull() & around.contains("--"), _pick(around, PROMPT)))


def _with_products(files: DataFrame) -> DataFrame:
    """Files with ``hits`` of catalog products: (rank, product, vendor, strength, source), by the first tag that names each,
    and those that only its bytes name.  Each step is a column of its own, so that none is computed more than once."""
    usable = F.filter("sorted", lambda t: ~t["key"].isin("xmp_history", "ai_parameters"))
    usable = F.transform(usable, lambda t: F.struct(t["ordinal"].alias("ordinal"), t["key"].alias("key"), t["value"].alias("value"), F.lower(t["value"]).alias("low")))

    def of_tag(t: Column) -> Column:
        program = t["key"].rlike(f"(?i)^(?:{catalog.PROGRAM_KEYS})$")
        strength = F.when(t["key"].rlike(f"(?i)^(?:{catalog.TOOL_KEYS})$"), "strong").otherwise("medium")
        source = F.concat(F.lit('tag "'), t["key"], F.lit('"'))
        found = lambda x: rules.found_in(t["value"], t["low"], x)
        named = [found(r) | (found(p) & program if p else F.lit(False)) for _, _, _, p, r, _ in catalog.PRODUCTS]
        return F.array_compact(F.array(*(F.when(n, _hit(i, t["ordinal"], strength, source)) for i, n in enumerate(named))))

    f = files.withColumn("every", F.array_sort(F.flatten(F.transform(usable, of_tag))))
    f = f.withColumn("tagged", F.filter("every", lambda h, i: (i == 0) | (F.get("every", i - 1)["rank"] != h["rank"])))
    raw = [F.when(rules.found_in(F.col("raw"), F.col("low"), w), _hit(i, F.lit(0), F.lit("medium"), F.lit("file data"))) for i, (*_, w) in enumerate(catalog.PRODUCTS) if w]
    alone = F.filter(F.array_compact(F.array(*raw)), lambda h: ~F.exists("tagged", lambda t: t["product"] == h["product"]))
    return f.withColumn("hits", F.concat("tagged", alone))


def _hit(i: int, ordinal: Column, strength: Column, source: Column) -> Column:
    name, vendor, *_ = catalog.PRODUCTS[i]
    return F.struct(F.lit(i).alias("rank"), ordinal.cast("int").alias("ordinal"), F.lit(name).alias("product"), F.lit(vendor).alias("vendor"), strength.alias("strength"), source.alias("source"))


def _evidence() -> Column:
    """Distinct (strength, source, detail, edited, made) of what raw text, single tags, credentials and products say."""
    c = F.col
    edited, known = c("source_type").startswith("composite"), c("credentials.status") != "unreadable"
    row = lambda when, strength, source, detail, edit=F.lit(False), make=F.lit(False): F.when(
        when, F.struct(strength.alias("strength"), F.lit(source).alias("source"), detail.alias("detail"), edit.alias("edited"), make.alias("made"))
    )
    strong, info, verified = F.lit("strong"), F.lit("info"), F.coalesce(known, F.lit(False))
    state = F.element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), c("credentials.status"))
    says = F.concat_ws(" ", F.when(c("credentials.edited"), "edited with AI").otherwise("created by AI"), F.concat(F.lit("("), c("credentials.agent"), F.lit(")")), F.concat(F.lit("["), state, F.lit("]")))
    marked = F.coalesce("credentials.marked", F.lit(False))
    found = [
        row(c("source_type").isNotNull(), strong, "IPTC / XMP label", F.concat(c("source_type"), F.when(edited, " (AI used to edit or composite)").otherwise(" (created by an AI model)")), edited, ~edited),
        row(c("source_type").isNull() & c("by_software"), info, "IPTC / XMP label", F.lit("algorithmicMedia")),
        row(c("google"), strong, "Google label", F.lit("Made with Google AI / SynthID")),
        row(c("meta"), strong, "Meta label", F.lit("Imagined with AI")),
        row(verified & marked, F.when(c("credentials.status") == "invalid", "medium").otherwise("strong"), "Content Credentials", says, c("credentials.edited"), ~c("credentials.edited")),
        row(verified & ~marked, info, "Content Credentials", F.concat_ws(" ", F.concat(F.lit("present ["), state, F.lit("]")), c("credentials.generator"), F.when(c("credentials.algorithmic"), "algorithmicMedia"))),
        row(~verified & c("told"), F.when(c("marked"), "medium").otherwise("info"), "Content Credentials", F.concat_ws(" ", F.lit("not verified"), F.when(c("marked"), "their text says AI-made"), c("generator"))),
        row(c("sd").isNotNull(), strong, "Generation settings", F.lit("Steps, Sampler, Seed, CFG scale")),
        row(c("comfy").isNotNull(), strong, "ComfyUI workflow", F.lit("node graph")),
        row(c("comfy").isNull() & c("invoke").isNotNull(), strong, "InvokeAI metadata", F.lit("generation metadata")),
        row(c("comfy").isNull() & c("invoke").isNull() & c("novel").isNotNull(), strong, "Comment JSON", F.lit("NovelAI-style settings")),
        row(c("job").isNotNull(), strong, "Midjourney metadata", c("job")),
    ]
    no = F.lit(False)
    products = F.transform("hits", lambda h: F.struct(h["strength"].alias("strength"), h["source"].alias("source"), h["product"].alias("detail"), no.alias("edited"), no.alias("made")))
    return F.array_distinct(F.concat(F.array_compact(F.array(*found)), products))


def judged(files: DataFrame) -> DataFrame:
    """The verdict on files that have their tags with them: path, raw, tags, and credentials where known.

    Columns: path, is_ai, confidence (confirmed, likely, none), label, tool, vendor, model, prompt, n_evidence, evidence.
    Credentials that were verified count strong, those that failed medium; unread ones by their text alone.
    """
    if "credentials" not in files.columns:
        files = files.withColumn("credentials", F.lit(None).cast(f"struct<{CREDENTIALS_TYPE.replace(' ', ':').replace(',:', ',')}>"))
    j = _with_products(_facts(files.select("path", "raw", "tags", "credentials"))).withColumn("evidence", _evidence())
    c = F.col
    has = lambda k: F.exists("evidence", lambda e: e["strength"] == k)
    confidence = F.when(has("strong"), "confirmed").when(has("medium"), "likely").otherwise("none")
    top = F.array_min(F.transform("hits", lambda h: F.struct(F.when(h["strength"] == "strong", 0).otherwise(1).alias("weak"), h["rank"].alias("rank"), h["product"].alias("tool"), h["vendor"].alias("vendor"))))
    told = F.coalesce(*(F.when(c("generator").rlike(rules.portable(r)), F.struct(F.lit(n).alias("tool"), F.lit(v).alias("vendor"))) for n, v, _, _, r, _ in catalog.PRODUCTS))
    named = F.when(c("marked"), told)
    sure = F.coalesce((c("credentials.status") != "unreadable") & c("credentials.marked"), F.lit(False))
    forge = c("sd")["version"].rlike(r"(?i)^f\d|forge")
    by = lambda when, tool, vendor: F.when(when, F.struct(tool.alias("t"), F.lit(vendor).alias("v")))
    made = F.coalesce(
        by(c("sd").isNotNull(), F.when(forge, "Stable Diffusion WebUI Forge").otherwise("Stable Diffusion WebUI (AUTOMATIC1111-style)"), "Stable Diffusion (open-source toolchain)"),
        by(c("comfy").isNotNull(), F.lit("ComfyUI"), "ComfyUI (open-source toolchain)"), by(c("invoke").isNotNull(), F.lit("InvokeAI"), "InvokeAI"), by(c("novel").isNotNull(), F.lit("NovelAI"), "NovelAI"),
    )
    midjourney = F.when(c("job").isNotNull(), "Midjourney")
    corpus = F.concat_ws("\n", F.map_values("tags"), c("generator"))
    model = F.coalesce(c("sd")["model"], c("comfy")["model"], F.get_json_object("invoke", "$.model.model_name"), F.get_json_object("invoke", "$.model.name"), F.when(c("confidence") != "none", origin.model_name(corpus)))
    edited = F.exists("evidence", lambda e: e["edited"]) & ~F.exists("evidence", lambda e: e["made"])
    label = F.when(c("confidence") == "none", "No AI marks found").when(c("confidence") == "likely", "Probably AI-generated").when(edited, "AI-assisted / AI-edited").otherwise("AI-generated")
    return j.withColumn("confidence", confidence).withColumn("top", top).select(
        "path", (c("confidence") != "none").alias("is_ai"), "confidence", label.alias("label"),
        F.coalesce(F.when(sure, c("credentials.agent")), made["t"], midjourney, c("top.tool"), named["tool"], F.when(c("marked"), c("generator"))).alias("tool"),
        F.coalesce(midjourney, F.when(sure, c("credentials.organization")), made["v"], c("top.vendor"), named["vendor"]).alias("vendor"),
        model.alias("model"), F.coalesce(c("sd")["prompt"], c("comfy")["prompt"], F.get_json_object("invoke", "$.positive_prompt"), F.get_json_object("novel", "$.prompt"), c("mj_prompt")).alias("prompt"),
        F.size("evidence").cast("bigint").alias("n_evidence"), F.transform("evidence", lambda e: F.struct(e["strength"].alias("strength"), e["source"].alias("source"), e["detail"].alias("detail"))).alias("evidence"),
    )


def analyse(files: DataFrame, tags: DataFrame) -> DataFrame:
    """``judged`` for files (path, raw) and their tags (path, ordinal, key, value) as tables of their own.

    * a file without tags or with null raw text is judged by what it has; tags of other files count for nothing;
    * repeated evidence counts once; of several products the first of strong, then of medium ones is named.
    """
    return judged(with_tags(files, tags)).drop("evidence")
