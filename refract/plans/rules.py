"""Rule catalogs and classifiers, over documents, and over tags and texts that are dealt to them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import ai_origin, classify, forensics, report, rules
from ..registry import dealt, dealt_sql, inline_sql, query, table

TEXT_RULES = [("license", r"\blicen[sc]ed?\b"), ("email", r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z]{2,}"), ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), ("secret", r"\b(?:token|password|api_key)\b"), ("card", r"\b\d{16}\b")]
_RULE_SQL = inline_sql("ordinal, rule, pattern", [f"({i}, '{n}', '(?i){p}')" for i, (n, p) in enumerate(TEXT_RULES)])
_HITS = f"SELECT doc_id, ordinal, rule FROM documents, (SELECT * FROM {_RULE_SQL}) r WHERE regexp_matches(text, pattern)"


def _hits(spark, d):
    return rules.match(table(spark, d, "documents").select("doc_id", "source", "text"), "text", TEXT_RULES)


@query(f"SELECT doc_id, rule FROM ({_HITS}) h")
def rule_hits(spark, d):
    return _hits(spark, d).select("doc_id", "rule")


@query(f"SELECT doc_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM ({_HITS}) h) x WHERE n = 1")
def rule_first_hit(spark, d):
    return rules.first_hits(_hits(spark, d), ["doc_id"], [F.col("ordinal")]).select("doc_id", "rule")


@query(f"""SELECT doc_id, CASE WHEN bool_or(rule IN ('secret', 'card')) THEN 'confirmed' WHEN bool_or(rule IN ('email', 'ip_address')) THEN 'likely' ELSE 'none' END AS confidence,
CAST(count(*) AS BIGINT) AS n_evidence FROM ({_HITS}) h GROUP BY doc_id""")
def rule_verdict(spark, d):
    strength = F.when(F.col("rule").isin("secret", "card"), "strong").when(F.col("rule").isin("email", "ip_address"), "medium").otherwise("info")
    return rules.verdict(_hits(spark, d).withColumn("strength", strength), "doc_id")


@query(f"SELECT DISTINCT source, rule FROM ({_HITS}) h JOIN documents USING (doc_id)")
def evidence_distinct(spark, d):
    return _hits(spark, d).dropDuplicates(["source", "rule"]).select("source", "rule")


# Three of these are the tags of each document, dealt by its id.
_SAMPLES = [
    ("Software", "Stable Diffusion XL base"), ("Comment", "made with ComfyUI"), ("comment", "made with suno"), ("title", "Suno and Udio.com mix"), ("Producer", "LibreOffice 24.2"), ("Creator", "Claude"),
    ("Make", "Canon"), ("keywords", "midjourney style"), ("encoder", "Lavf58.29"), ("description", "Runway Gen-3 clip"), ("ISFT", "ElevenLabs"), ("Application", "Gamma"), ("xmp_history", "midjourney"),
    ("note", "gamma correction by claude monet"), ("Model", "EOS R5"), ("artist", "A. Person"), ("title", "Untitled"),
]
# One of these follows the text of each document where its bytes are searched.
_MARKS = [
    "", "", "", "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia", "Made with Google AI", "imagined with AI", "Job ID: 0f8fad5b-d9cb-469f-a165-70867728950e",
    "Steps: 28, Sampler: Euler a, Seed: 7", "c2pa.actions by ChatGPT 2024-05-01T10:00:00Z", "urn:c2pa Adobe_Firefly: trainedAlgorithmicMedia", "automatic1111", "", "novelai",
]
_COLS = "path, ordinal, key, value"
_Q = lambda s: "'" + s.replace("'", "''") + "'" if s is not None else "NULL"
_PRODUCT_SQL = inline_sql("rank, product, vendor, program, pattern", [f"({i}, {_Q(n)}, {_Q(v)}, {_Q('(?i)' + p if p else None)}, {_Q('(?i)' + r)})" for i, (n, v, k, p, r, w) in enumerate(catalog.PRODUCTS)])
_TAG_SQL = f"""(SELECT CAST(d.doc_id AS VARCHAR) AS path, o.ordinal, s.key, s.value FROM documents d, (SELECT unnest([1, 2, 3]) AS ordinal) o, (SELECT * FROM {inline_sql("i, key, value", [f"({i}, {_Q(k)}, {_Q(v)})" for i, (k, v) in enumerate(_SAMPLES)])}) s
  WHERE s.i = (d.doc_id * 7 + o.ordinal * 3) % {len(_SAMPLES)})"""
_RAW_SQL = f"""(SELECT CAST(d.doc_id AS VARCHAR) AS path, coalesce(d.text, '') || ' ' || m.mark AS raw FROM documents d, (SELECT * FROM {inline_sql("i, mark", [f"({i}, {_Q(m)})" for i, m in enumerate(_MARKS)])}) m WHERE m.i = d.doc_id % {len(_MARKS)})"""


def _tags(spark, d):
    samples = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in _SAMPLES))
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ordinal"))
    t = t.withColumn("s", F.get(samples, ((F.col("doc_id") * 7 + F.col("ordinal") * 3) % len(_SAMPLES)).cast("int")))
    return t.select(F.col("doc_id").cast("string").alias("path"), "ordinal", "s.key", "s.value")


def _raw(spark, d):
    mark = F.get(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % len(_MARKS)).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), mark).alias("raw"))


_PRODUCT_HITS = f"""SELECT path, product, vendor, key, rank, CASE WHEN regexp_matches(key, '(?i)^(?:{catalog.TOOL_KEYS})$') THEN 'strong' ELSE 'medium' END AS strength FROM (
  SELECT *, row_number() OVER (PARTITION BY path, product ORDER BY ordinal) AS n FROM {_TAG_SQL} tg, (SELECT * FROM {_PRODUCT_SQL}) pr
  WHERE key NOT IN ('xmp_history', 'ai_parameters') AND (regexp_matches(value, pattern)
     OR (program IS NOT NULL AND regexp_matches(value, program) AND regexp_matches(key, '(?i)^(?:{catalog.PROGRAM_KEYS})$')))) x WHERE n = 1"""


@query(f"SELECT path, product, vendor, key, strength FROM ({_PRODUCT_HITS}) h")
def product_catalog_match(spark, d):
    return rules.product_hits(_tags(spark, d)).select("path", "product", "vendor", "key", "strength")


@query(f"""SELECT path, product AS tool, vendor FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN strength = 'strong' THEN 0 ELSE 1 END, rank) AS m FROM ({_PRODUCT_HITS}) h) y WHERE m = 1""")
def product_headline(spark, d):
    return rules.headline(rules.product_hits(_tags(spark, d)))


_RAW_PRODUCTS = inline_sql("rank, product, vendor, raw_pattern", [f"({i}, {_Q(n)}, {_Q(v)}, {_Q('(?i)' + w)})" for i, (n, v, _, _, _, w) in enumerate(catalog.PRODUCTS) if w])
_REGION = "regexp_extract(raw, '(?is)(?:c2pa\\.(?:actions|hash|claim|assertions|created|opened|signature)|urn:c2pa|contentauth).*', 0)"
_AI_SQL = f"""WITH raw AS {_RAW_SQL}, hits AS ({_PRODUCT_HITS}),
named AS (SELECT path, product, vendor, rank, 'medium' AS strength, 'file data' AS source FROM raw, (SELECT * FROM {_RAW_PRODUCTS}) p WHERE regexp_matches(raw, raw_pattern) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = raw.path AND h.product = p.product)),
both_ AS (SELECT path, product, vendor, rank, strength, 'tag "' || key || '"' AS source FROM hits UNION ALL SELECT * FROM named),
facts AS (SELECT path, regexp_extract(raw, '\\b(compositeWithTrainedAlgorithmicMedia|trainedAlgorithmicMedia|compositeSynthetic)\\b', 1) AS st, regexp_matches(raw, '\\balgorithmicMedia\\b') AS sw, regexp_matches(raw, '(?i)Made with Google AI|SynthID') AS g,
  regexp_matches(raw, '(?i)Imagined with AI') AS m, {_REGION} <> '' AS cr, regexp_matches({_REGION}, 'trainedAlgorithmicMedia|compositeWithTrainedAlgorithmicMedia|compositeSynthetic') AS mk, regexp_matches(raw, 'Steps:\\s*\\d+,\\s*Sampler:') AS sd, regexp_matches(raw, 'Job ID:\\s*[0-9a-f]{{8}}-') AS job FROM raw),
ev AS (SELECT path, CASE WHEN starts_with(st, 'composite') THEN 'edited' ELSE 'made' END AS kind, 'strong' AS strength FROM facts WHERE st <> '' UNION ALL SELECT path, '', 'info' FROM facts WHERE st = '' AND sw UNION ALL SELECT path, '', 'strong' FROM facts WHERE g
  UNION ALL SELECT path, '', 'strong' FROM facts WHERE m UNION ALL SELECT path, '', CASE WHEN mk THEN 'medium' ELSE 'info' END FROM facts WHERE cr UNION ALL SELECT path, '', 'strong' FROM facts WHERE sd UNION ALL SELECT path, '', 'strong' FROM facts WHERE job
  UNION ALL SELECT path, '', strength FROM (SELECT DISTINCT path, source, product, strength FROM both_) z),
v AS (SELECT path, CASE WHEN bool_or(strength = 'strong') THEN 'confirmed' WHEN bool_or(strength = 'medium') THEN 'likely' ELSE 'none' END AS confidence, bool_or(kind = 'edited') AND NOT bool_or(kind = 'made') AS edited, count(*) AS n FROM ev GROUP BY path),
top AS (SELECT path, product, vendor FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN strength = 'strong' THEN 0 ELSE 1 END, rank) AS k FROM both_) y WHERE k = 1)
SELECT path, coalesce(confidence, 'none') AS confidence, coalesce(confidence, 'none') <> 'none' AS is_ai,
  CASE coalesce(confidence, 'none') WHEN 'none' THEN 'No AI marks found' WHEN 'likely' THEN 'Probably AI-generated' ELSE CASE WHEN edited THEN 'AI-assisted / AI-edited' ELSE 'AI-generated' END END AS label,
  CASE WHEN sd THEN 'Stable Diffusion WebUI (AUTOMATIC1111-style)' WHEN job THEN 'Midjourney' ELSE product END AS tool, CASE WHEN job THEN 'Midjourney' WHEN sd THEN 'Stable Diffusion (open-source toolchain)' ELSE vendor END AS vendor, CAST(coalesce(n, 0) AS BIGINT) AS n_evidence
FROM facts LEFT JOIN v USING (path) LEFT JOIN top USING (path)"""


@query(_AI_SQL)
def ai_verdict(spark, d):
    """One scan: the tags of a document are dealt beside its text."""
    samples = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in _SAMPLES))
    mark = F.get(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % len(_MARKS)).cast("int"))
    dealt = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda o: F.struct(o.alias("ordinal"), F.get(samples, ((F.col("doc_id") * 7 + o * 3) % len(_SAMPLES)).cast("int")).alias("s")))
    tags = F.transform(dealt, lambda t: F.struct(t["ordinal"].alias("ordinal"), t["s"]["key"].alias("key"), t["s"]["value"].alias("value")))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), mark).alias("raw"), tags.alias("tags"))
    return ai_origin.judged(rows).drop("model", "prompt", "evidence")


_SETTINGS = ["(1, 'a castle, oil painting Negative prompt: blurry Steps: 28, Sampler: DPM++ 2M, CFG scale: 7, Seed: 1234567890, Size: 768x768, Model: sd_xl_base_1.0, Version: v1.6')", "(2, 'Steps: 30, Sampler: Euler a, Seed: 99, Model: dreamshaper_8')", "(3, 'no settings here')"]


@query(f"""SELECT id, regexp_matches(s, 'Steps:\\s*\\d+,\\s*Sampler:') AS found, nullif(regexp_extract(s, 'Steps:\\s*(\\d+)', 1), '') AS steps, nullif(regexp_extract(s, 'Sampler:\\s*([^,]+)', 1), '') AS sampler,
nullif(regexp_extract(s, 'Seed:\\s*([^,]+)', 1), '') AS seed, nullif(regexp_extract(s, ', Model:\\s*([^,]+)', 1), '') AS model, nullif(trim(regexp_extract(s, 'Negative prompt:\\s*(.*?)\\s*Steps:', 1)), '') AS negative
FROM {dealt_sql("id, s", _SETTINGS)}""")
def sd_settings_parse(spark, d):
    pick = lambda p: F.nullif(F.trim(F.regexp_extract("s", p, 1)), F.lit(""))
    return dealt(spark, d, "id, s", _SETTINGS).select(
        "id", F.col("s").rlike(r"Steps:\s*\d+,\s*Sampler:").alias("found"), pick(r"Steps:\s*(\d+)").alias("steps"), pick(r"Sampler:\s*([^,]+)").alias("sampler"),
        pick(r"Seed:\s*([^,]+)").alias("seed"), pick(r", Model:\s*([^,]+)").alias("model"), pick(r"Negative prompt:\s*(.*?)\s*Steps:").alias("negative"),
    )


_JSON = ["""(1, '{"3": {"class_type": "KSampler", "inputs": {"seed": 7, "steps": 20}}, "4": {"class_type": "Loader", "inputs": {"ckpt_name": "flux1-dev.safetensors"}}}')""", """(2, '{"prompt": "a cat", "steps": 28, "seed": 5}')""", """(3, 'not json')"""]


@query(f"""SELECT id, coalesce(json_valid(j), false) AS is_json, CASE WHEN json_valid(j) THEN json_extract_string(j, '$."3".class_type') END AS sampler_class,
regexp_replace(CASE WHEN json_valid(j) THEN json_extract_string(j, '$."4".inputs.ckpt_name') END, '(?i)\\.(safetensors|ckpt|gguf)$', '') AS model, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.prompt') END AS prompt
FROM {dealt_sql("id, j", _JSON)}""")
def comfy_graph(spark, d):
    v = dealt(spark, d, "id, j", _JSON).withColumn("v", F.try_parse_json("j"))
    text = lambda p: F.try_variant_get("v", p, "string")
    model = F.regexp_replace(text('$["4"].inputs.ckpt_name'), r"(?i)\.(safetensors|ckpt|gguf)$", "")
    return v.select("id", F.col("v").isNotNull().alias("is_json"), text('$["3"].class_type').alias("sampler_class"), model.alias("model"), text("$.prompt").alias("prompt"))


_MODELS = ["(1, 'iPhone15,2')", "(2, 'SM-S918B')", "(3, 'sm-s9280')", "(4, 'ILCE-1')", "(5, 'ILCE-7M4')", "(6, 'ILCE-1M2')", "(7, 'ILME-FX30')", "(8, 'Pixel 8')", "(9, ' FC3582 ')"]
_DEVICE_SQL = inline_sql("rank, code, product, maker, hardware", [f"({i}, {_Q(a)}, {_Q(b)}, {_Q(c)}, {_Q(h)})" for i, (a, b, c, h, _) in enumerate(catalog.DEVICES)])


@query(f"""SELECT id, model, product, maker, hardware FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN trim(model) = code THEN 0 ELSE 1 END, rank) AS n
FROM (SELECT * FROM {dealt_sql("id, model", _MODELS)}) m LEFT JOIN (SELECT * FROM {_DEVICE_SQL}) dv ON trim(model) = code OR starts_with(upper(trim(model)), upper(code))) x WHERE n = 1""")
def model_prefix_lookup(spark, d):
    """Each model code is looked up once, however many files have it."""
    found = dealt(spark, d, "id, model", _MODELS)
    return found.join(rules.device_products(found.select("model").distinct()), "model").select("id", "model", "product", "maker", "hardware")


_FILES = [
    "(1, 'Apple', 'iPhone 14 Pro', NULL, NULL, '2024:01:02 10:00:00', '2024:01:05 14:30:00', false, false)", "(2, NULL, NULL, 'Zoom H6', NULL, '2024-01-02 10:00:00', '2024-01-02 10:00:30', false, false)",
    "(3, NULL, NULL, NULL, 'Adobe Photoshop 25', '2024-01-02 10:00:00', NULL, false, false)", "(4, NULL, NULL, NULL, 'Lavf58.29.100', NULL, NULL, false, false)", "(5, NULL, NULL, NULL, 'LibreOffice', '2024-01-02 10:00:00', '2024-01-02 12:05:00', true, false)",
    "(6, NULL, NULL, NULL, NULL, NULL, NULL, false, true)", "(7, 'Canon', 'Canon EOS R5', NULL, 'com.apple.CoreAudio', NULL, NULL, false, false)", "(8, NULL, NULL, NULL, 'LAME3.100', 'bad', '2024-01-01 00:00:00', false, false)",
]
_FILE_COLS = "id, make, model, originator, software, created, modified, is_document, is_ai"


def _sig_sql():
    out = []
    for words, dev, maker, hw in classify.SIGNATURES:
        cond = " OR ".join(f"contains(s, '{w}')" for w in words)
        out.append((cond, dev, maker, hw))
    return out


def _case(i: int) -> str:
    return " ".join(f"WHEN {c} THEN {_Q(x[i])}" for c, *x in _sig_sql())


@query(f"""SELECT id, CASE WHEN make IS NOT NULL OR model IS NOT NULL THEN CASE WHEN starts_with(lower(coalesce(model, '')), lower(coalesce(make, ''))) THEN coalesce(model, '') ELSE trim(coalesce(make, '') || ' ' || coalesce(model, '')) END
  WHEN originator IS NOT NULL THEN originator {_case(0)} ELSE {_Q(classify.UNTAGGED[0])} END AS device,
 CASE WHEN make IS NOT NULL OR model IS NOT NULL THEN make WHEN originator IS NOT NULL THEN split_part(originator, ' ', 1) {_case(1)} ELSE {_Q(classify.UNTAGGED[1])} END AS maker,
 CASE WHEN make IS NOT NULL OR model IS NOT NULL THEN 'Physical Hardware Device' WHEN originator IS NOT NULL THEN 'Studio Audio Hardware Recorder' {_case(2)} ELSE {_Q(classify.UNTAGGED[2])} END AS hardware
FROM (SELECT *, lower(coalesce(software, '')) AS s FROM {dealt_sql(_FILE_COLS, _FILES)}) f""")
def device_rules(spark, d):
    c = F.col
    return dealt(spark, d, _FILE_COLS, _FILES).withColumn("d", classify.device(c("make"), c("model"), c("originator"), c("software"))).select("id", "d.device", "d.maker", "d.hardware")


_EDIT = " OR ".join(f"contains(s, '{w}')" for w in classify.EDITORS)
_ENC = " OR ".join(f"contains(s, '{w}')" for w in classify.ENCODERS)
_TS = lambda c: f"epoch(try_cast(regexp_replace({c}, '^(\\d{{4}}):(\\d{{2}}):(\\d{{2}})', '\\1-\\2-\\3') AS TIMESTAMP))"


@query(f"""WITH f AS (SELECT *, lower(coalesce(software, '')) AS s, CAST({_TS("modified")} - {_TS("created")} AS BIGINT) AS gap,
  CASE WHEN modified IS NOT NULL AND modified IS DISTINCT FROM created THEN 2 ELSE 1 END AS events FROM {dealt_sql(_FILE_COLS, _FILES)})
SELECT id, gap, CASE WHEN is_ai THEN 'AI_GENERATED' WHEN NOT is_document AND (({_EDIT}) OR (coalesce(gap > 60, false) AND events > 1)) THEN 'TAMPERED' WHEN is_document AND coalesce(gap > 60, false) THEN 'EDITED_LATER'
 WHEN ({_ENC}) OR coalesce(gap > 60, false) THEN 'RE_ENCODED' ELSE 'AUTHENTIC_ORIGINAL' END AS verdict,
 CASE WHEN gap > 60 THEN CASE WHEN gap // 86400 > 0 THEN (gap // 86400) || ' days, ' || ((gap % 86400) // 3600) || ' hours later' WHEN gap // 3600 > 0 THEN (gap // 3600) || ' hours, ' || ((gap % 3600) // 60) || ' minutes later' ELSE (gap // 60) || ' minutes later' END END AS later
FROM f""")
def tamper_verdict(spark, d):
    c = F.col
    f = dealt(spark, d, _FILE_COLS, _FILES).withColumn("gap", classify.elapsed(c("created"), c("modified")))
    events = F.when(c("modified").isNotNull() & ~c("modified").eqNullSafe(c("created")), 2).otherwise(1)
    v = classify.tampering(c("is_document"), c("is_ai"), c("software"), c("created"), c("modified"), events, F.lit(False))
    return f.select("id", "gap", v.alias("verdict"), classify.elapsed_text(c("gap")).alias("later"))


_HEADS = [
    "(1, '504B030414000600', 'docx')", "(2, '0000001866747970686569630000000000', 'heic')", "(3, '000000186674797069736F6D0000000000', 'mp4')", "(4, '5249464624000000574156456D', 'wave')", "(5, '4944330400000000', 'mp3')",
    "(6, 'FFFE48006900', 'txt')", "(7, '664C614300000022', 'flac')", "(8, '4F67675300020000', 'ogg')", "(9, '1A45DFA3A3428681', 'webm')", "(10, 'FFD8FFE000104A46', 'jpg')", "(11, '89504E470D0A1A0A', 'png')",
    "(12, '5249464624000000574542505650', 'webp')", "(13, '474946383961', 'gif')", "(14, '255044462D312E37', 'pdf')", "(15, '48656C6C6F20776F', 'txt')", "(16, '', 'bin')",
]
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_HEX = lambda s: s.encode().hex().upper()


@query(f"""SELECT id, CASE WHEN h[1:6] IN ('504B03', '504B05') THEN 'zip' WHEN (h[9:16] = '{_HEX("ftyp")}' AND length(h) > 24 AND h[17:24] IN ({_IN([_HEX(b) for b in forensics.STILL_BRANDS])})) OR e IN ({_IN(forensics.STILL_EXTENSIONS)}) THEN 'heif'
 WHEN e IN ({_IN(forensics.MP4_EXTENSIONS)}) OR h[9:16] IN ({_IN([_HEX(b) for b in forensics.MP4_BOXES])}) THEN 'mp4' WHEN h[1:8] = '{_HEX("RIFF")}' AND h[17:24] = '{_HEX("WAVE")}' THEN 'wav'
 WHEN e = 'mp3' OR h[1:6] = '494433' OR (h[1:2] = 'FF' AND h[3:4] >= 'E0') THEN 'mp3' WHEN e = 'flac' OR h[1:8] = '{_HEX("fLaC")}' THEN 'flac' WHEN e IN ('ogg', 'opus') OR h[1:8] = '{_HEX("OggS")}' THEN 'ogg'
 WHEN e IN ('webm', 'mkv') OR h[1:8] = '1A45DFA3' THEN 'webm' WHEN e IN ('jpg', 'jpeg') OR h[1:4] = 'FFD8' THEN 'jpeg' WHEN e = 'png' OR h[1:8] = '89504E47' THEN 'png'
 WHEN e = 'webp' OR (h[1:8] = '{_HEX("RIFF")}' AND h[17:24] = '{_HEX("WEBP")}') THEN 'webp' WHEN e = 'gif' OR h[1:6] = '474946' THEN 'gif' WHEN e = 'pdf' OR h[1:8] = '25504446' THEN 'pdf' ELSE 'generic' END AS format,
 CASE WHEN h[1:4] = 'FFD8' THEN 'image/jpeg' WHEN h[1:6] = '89504E' THEN 'image/png' WHEN h[1:8] = '{_HEX("RIFF")}' THEN 'audio/wav' WHEN h[9:16] = '{_HEX("ftyp")}' THEN 'video/mp4' WHEN h[1:6] = '494433' THEN 'audio/mpeg'
 WHEN h[1:8] = '25504446' THEN 'application/pdf' WHEN h[1:8] = '1A45DFA3' THEN 'video/webm' ELSE 'application/octet-stream' END AS mime FROM {dealt_sql("id, h, e", _HEADS)}""")
def format_dispatch(spark, d):
    content = F.unhex("h")
    return dealt(spark, d, "id, h, e", _HEADS).select("id", forensics.format_of(content, F.col("e")).alias("format"), forensics.mime_magic(content).alias("mime"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, max(n_chars) AS longest, arg_min(doc_id, (CASE WHEN lang = 'en' THEN 0 ELSE 1 END) * 1000000000 + doc_id) AS first_doc FROM documents GROUP BY source""")
def ranked_first(spark, d):
    rank = F.struct(F.when(F.col("lang") == "en", 0).otherwise(1), F.col("doc_id"))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"), F.min_by("doc_id", rank).alias("first_doc"))


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 60 AS BOOLEAN) AS late FROM events""")
def audit_trail(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("step"), (gap > 60).alias("late"))


_ENDINGS = ("png", "pdf", "mp3", "mp4", "bin", "m4a", "docx", "mov")
_END = f"CASE doc_id % {len(_ENDINGS)} " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDINGS)) + " END"


@query(f"""WITH f AS (SELECT doc_id, {_END} AS e, doc_id % 3 = 0 AS sound, doc_id % 5 < 2 AS film FROM documents),
r AS (SELECT *, CASE WHEN sound THEN NULL WHEN e = 'png' THEN 'image' WHEN e IN ('pdf', 'docx') THEN 'document' WHEN film AND e IN ('mp3', 'm4a') THEN NULL WHEN film THEN 'silent' WHEN e IN ('mp3', 'm4a', 'mp4', 'mov') THEN NULL ELSE 'unknown' END AS reason FROM f)
SELECT doc_id, reason IS NULL AS available, NOT sound AND reason IS NULL AS unsure, coalesce(reason = 'unknown', false) AS can_try, reason FROM r""")
def cleaning_support(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(_END).alias("e"), (F.col("doc_id") % 3 == 0).alias("sound"), (F.col("doc_id") % 5 < 2).alias("film"))
    return t.select("doc_id", report.cleaning_support(F.col("sound"), F.col("film"), F.col("e"), F.lit(None).cast("string")).alias("s")).select("doc_id", "s.*")


@query("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS sha256 FROM documents WHERE text IS NOT NULL""")
def escaped_texts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(report.escaped(F.col("text")), 256).alias("sha256"))
